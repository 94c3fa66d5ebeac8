"""Quality rules by distribution divergence, in DataFrame expressions only.

Each document's character-class histogram and common-word histogram are held against those of its language by
Jensen-Shannon distance (base 2, 0 to 1). A language's reference is the sum over all its documents that pass the
base rules; every language that occurs has one of character classes, those with listed words one of words too. Documents
with too few characters or words for a histogram are not judged by that distance.

Defined results: a null or empty text has no words and fails the base rule (n_words < 10); with a null language only the
base rule counts, as such documents have no language in common; very long texts are judged whole like any other; repeated
rows are judged each by itself; columns other than id, text and language are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, Workspace, let, spread

#: The commonest function words of each language that has a reference.
COMMON_WORDS = {
    "de": ["das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "und", "von", "zu"],
    "en": ["a", "and", "are", "as", "at", "by", "for", "in", "is", "it", "of", "on", "that", "the", "to", "was"],
    "es": ["con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "por", "que", "se", "un", "una", "y"],
    "fr": ["de", "des", "du", "en", "est", "et", "la", "le", "les", "ne", "pas", "pour", "que", "un", "une", "à"],
}
#: Character classes, each removed in turn from what the ones before it left; the rest is the last class.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "space": r"[\x20\x09-\x0D]+", "other_script": r"[^\x00-\x7F]+", "digit": "[0-9]+", "point": r"[.,;:!?'\"()-]+"}
SYMBOLS = "#*$%&|<>"
#: Distances above these reject; documents below the minimum lengths are not judged.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS = 0.24, 0.305, 200, 60
WINDOW = 5


def _repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words in n-word windows found twice or more, in one row: sort window hashes with their places, join equal neighbours."""

    def covered(wins: Column) -> Column:
        pairs = F.sort_array(F.transform(wins, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0)).otherwise(let(pairs, lambda s: let(places(s), total)))

    def places(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        js = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(js, lambda j: F.get(s, j)["p"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > n, let(hashes, lambda h: let(windows(h), covered))).otherwise(F.lit(0)).cast("long")


def _common(words: Column, listed: list[str]) -> Column:
    """The listed words of a text in order, each as one letter, so that counting them is counting letters."""
    forms = {w: chr(97 + k) for k, w in enumerate(listed)}
    forms |= {w.capitalize(): c for w, c in forms.items()}
    code = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    return F.array_join(F.transform(F.filter(words, lambda w: w.isin(list(forms))), lambda w: code[w]), "")


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row of counts a document, from one pass over the text."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t0"))
    df = spread(df, "doc_id")
    out = {}
    for k, (name, pattern) in enumerate(CLASSES.items()):
        df = df.withColumn(f"t{k + 1}", F.regexp_replace(f"t{k}", pattern, ""))
        out[f"c_{name}"] = F.length(f"t{k}") - F.length(f"t{k + 1}")
    out["c_rest"] = F.length(f"t{len(CLASSES)}")
    trimmed = F.btrim("t0", F.lit(SPACES))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split("t0", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    df = df.select("doc_id", "lang", "t0", *[v.alias(k) for k, v in out.items()], words.alias("words"), lines.alias("lines"))
    coded = reduce(lambda rest, lang: F.when(F.col("lang") == lang, _common(F.col("words"), COMMON_WORDS[lang])).otherwise(rest), COMMON_WORDS, F.lit(""))
    df = df.select(
        "doc_id",
        "lang",
        *out,
        F.size("words").cast("long").alias("n_words"),
        (F.length("t0") - F.col("c_space")).cast("long").alias("word_chars"),
        (F.length("t0") - F.length(F.translate("t0", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        coded.alias("coded"),
    )
    most = max(map(len, COMMON_WORDS.values()))
    counts = [(F.length("coded") - F.length(F.replace("coded", F.lit(chr(97 + k)), F.lit("")))).alias(f"w_{k}") for k in range(most)]
    return df.select(*[c for c in df.columns if c != "coded"], *counts, (F.col("n_words") - F.length("coded")).cast("int").alias("w_rest"))


def js_distance(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null where either is empty."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    def shares(h: Column) -> Column:
        return let(F.aggregate(h, F.lit(0.0), lambda s, x: s + x), lambda s: F.when(s > 0, F.transform(h, lambda x: x / s)))

    def joined(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda s, x: s + x)

    hist = lambda cols: F.array(*[c.cast("double") for c in cols])
    return let(joined(shares(hist(p)), shares(hist(q))) / 2, lambda d: F.sqrt(F.when(d < 0, F.lit(0.0)).otherwise(d)))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    The text is read once; counts go to a narrow table in the shared folder, from which references and distances come.
    """
    ws = Workspace(docs.sparkSession)
    features = text_features(docs, id_col, text_col, lang_col)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    features = ws.save(features.withColumn("base_failed", base), "features")
    chars = [c for c in features.columns if c.startswith("c_")]
    commons = [c for c in features.columns if c.startswith("w_")]
    passing = features.where(~F.col("base_failed") & F.col("lang").isNotNull())
    reference = passing.groupBy("lang").agg(*[F.sum(c).alias(f"ref_{c}") for c in (*chars, *commons)])
    # a row a language, written, so that the planner knows its size and broadcasts it only where it is small
    both = features.join(ws.save(reference, "reference"), "lang", "left")
    n_chars = reduce(add, [F.col(c) for c in chars])
    distance = lambda names: js_distance([F.col(c) for c in names], [F.col(f"ref_{c}") for c in names])
    judged = both.withColumns(
        {
            "char_distance": F.when(n_chars >= min_chars, distance(chars)),
            "word_distance": F.when((F.col("n_words") >= min_words) & F.col("lang").isin(list(COMMON_WORDS)), distance(commons)),
        }
    )
    far = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept")
    )
