"""Token ids by word: a bounded memo in front of a BPE tokenizer whose tokens never cross white space.

word_bpe_49k.json drops white space and puts end-of-word marks, so the ids of a text are those of its
white-space-separated words one after another, and upper and lower case ASCII letters give the same ids.
Texts with "<|" go to the library whole, as special strings in them are matched before all else.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordIds:
    """Rows of word -> ids; the memo starts afresh when it holds max_words, so memory stays bounded."""

    CUT = b".,!?;:"
    MARK = b" <|endoftext|> "

    def __init__(self, path: str, max_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.max_words = max_words
        # what the memo relies on: words are encoded each by itself, in lower case, and special strings begin with "<|"
        parts = [self.library.encode(w, add_special_tokens=False).ids for w in ("ab,", "Çd's", "12x", "(é)")]
        if self.library.encode("AB,\t çD's\n12x  (É)", add_special_tokens=False).ids != sum(parts, []):
            raise ValueError(f"not a tokenizer of single lower-case words: {path}")
        if odd := [t.content for t in self.library.get_added_tokens_decoder().values() if not t.content.startswith("<|") or len(t.content.split()) != 1]:
            raise ValueError(f"special strings that don't begin with <|: {odd}")
        names = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        for name, i in names.items():
            self.ends_word[i] = name.endswith("</w>")
        self.mark = self.library.token_to_id(self.MARK.strip().decode())
        self._clear()

    def _clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.count = np.zeros(1024, np.int32)
        self.start = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0
        self._put([b""], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(memo rows of all words of these texts, number of words up to each text); texts are cut and words told apart in Arrow."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        at = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        return self.rows(coded.dictionary.cast(pa.binary()).to_pylist())[coded.indices.to_numpy()], at - at[0]

    def whole(self, text: bytes) -> np.ndarray:
        """Ids of one text by the library alone."""
        return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The memo's row of each word. Rows hold until the next call of trim()."""
        get = self.row.get
        found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            lost = [words[i] for i in missing.tolist()]
            self._learn(set(lost))
            found[missing] = np.fromiter(map(self.row.__getitem__, lost), np.int64, len(lost))
        return found

    def counts(self, words: list[bytes]) -> np.ndarray:
        rows = self.rows(words)
        return self.count[rows].astype(np.int64)

    def trim(self) -> None:
        if len(self.row) > self.max_words:
            self._clear()

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """All ids of these rows, in order."""
        n = self.count[rows].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[rows] - (ends - n), n) + np.arange(total)]

    def _learn(self, words: set[bytes]) -> None:
        """Letters are one unit of the tokenizer and a stop behind a letter another, and each unit's last id ends a word.

        So many words go to the library in one text, parted again by counting those ids.
        """
        letters = lambda w: w.isalpha() or (not w.isascii() and w.decode("utf-8", "replace").isalpha())
        cut, one, two, rest = self.CUT, [], [], []
        for w in words:
            if letters(w):
                one.append(w)
            elif w[-1] in cut and letters(w[:-1]):
                two.append(w)
            else:
                rest.append(w)
        for listed, units in ((one, 1), (two, 2)):
            for at in range(0, len(listed), 1000):
                part = listed[at : at + 1000]
                ids = np.array(self.library.encode_batch_fast([b" ".join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == units * len(part):
                    self._put(part, ids, np.diff(ends[units - 1 :: units], prepend=0))
                else:  # a letter whose lower case is more than letters
                    rest += part
        for at in range(0, len(rest), 1000):  # any other word: a special token between them, which no word holds
            part = rest[at : at + 1000]
            ids = np.array(self.library.encode_batch_fast([self.MARK.join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.concatenate([[-1], np.flatnonzero(ids == self.mark), [len(ids)]])
            self._put(part, ids[ids != self.mark], np.diff(marks) - 1)

    def _put(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        at, n, used = len(self.row), len(words), self.used + len(ids)
        if at + n > len(self.count):
            size = 2 * (at + n)
            self.count, self.start = np.resize(self.count, size), np.resize(self.start, size)
        if used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * used)
        self.row.update(zip(words, range(at, at + n), strict=True))
        self.count[at : at + n] = counts
        self.start[at : at + n] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : used] = ids
        self.used = used


_tables: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One memo a Python worker."""
    if path not in _tables:
        _tables[path] = WordIds(path)
    return _tables[path]


def ids_of(texts: pa.Array, memo: WordIds) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """As WordIds.split, but texts with "<|" have no words here and are listed for the library."""
    texts = pc.fill_null(texts, "")
    special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
    if len(special):
        mask = np.zeros(len(texts), bool)
        mask[special] = True
        texts = pc.if_else(pa.array(mask), "", texts)
    memo.trim()
    rows, at = memo.split(texts)
    return rows, at, special.tolist()
