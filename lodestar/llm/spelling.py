"""Spelling variants by asymmetric q-chunks: words of a corpus that one inserted, deleted or replaced code point keeps apart.

One word of a pair gives two disjoint chunks, the other all positional grams that can meet a chunk: an edit touches one chunk at most,
and the other stands in the second word, moved by no more than one place. A chunk before the edit isn't moved, and one behind it is
moved by the difference of the lengths, so of a word's grams only those at such places are written out, and chunks and grams meet by
an equi-join. The join is exact, whatever the words: each pair is verified.

Where very many words share a chunk, what stays open between the chunks that are kept is cut into two chunks again, and so on, until
few words share a key or one code point is open, which is all but the edit itself. So a frequent stem makes no pairs of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import stored

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Code points of a word and its occurrences at least; one run in so many loses a letter; how often a form must occur against its variant.
LENGTH, COUNT, TYPO, RATIO = 5, 3, 97, 2
#: Words that share a key at most before it is refined.
SHARED = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, all else as it is; words of ASCII take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_typos(word: Column, id: Column, one_in: int) -> Column:
    """The word, or if crc32 of ``id:word`` is divisible, the word without the code point at crc32 modulo its length."""
    h = F.crc32(F.concat(id.cast("string"), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, typo: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the maximal runs of letters of all texts, A to Z in lower case, long and frequent enough. With ``typo``, one run in
    so many loses a code point first. Counts are combined in each task before words are shuffled."""
    # a run of fewer letters can't become a word
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rf"({LETTERS})"))).alias("run"))
    runs = runs.where(F.length("run") >= LENGTH).select("id", lower_ascii(F.col("run")).alias("run"))
    word = F.col("run") if typo is None else with_typos(F.col("run"), F.coalesce(F.col("id").cast("string"), F.lit("")), typo)
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.length("word") >= LENGTH) & (F.col("n") >= COUNT))


def _key(word: str, length: str) -> Column:
    """Hash of the first ``a`` and last ``b`` code points, their places and the length of the word that gives chunks."""
    ends = (F.substring(F.col(word), F.lit(1), F.col("a")), F.substring(F.col(word), F.length(word) - F.col("b") + 1, F.col("b")))
    return F.xxhash64(*ends, F.col(length), F.col("a"), F.col("b"))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row with the open part cut in two: the first or the last half of it is a chunk that is kept as well."""
    half = ((F.col("l") - F.col("a") - F.col("b")) / 2).cast("int")
    ways = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + half).alias("b")))
    out = rows.select("word", "n", "chunk", "l", F.explode(ways).alias("way")).select("word", "n", "chunk", "l", "way.a", "way.b")
    return out.withColumn("key", _key("word", "l"))


def _one_edit() -> Column:
    """The kept ends of both words are equal, and one edit is all between them; so what is compared letter by letter is the open part."""
    part = lambda w, at, n: F.substring(F.col(w), at, n)
    first = part("word", F.lit(1), F.col("a")) == part("near", F.lit(1), F.col("a"))
    last = part("word", F.length("word") - F.col("b") + 1, F.col("b")) == part("near", F.length("near") - F.col("b") + 1, F.col("b"))
    open_ = [part(w, F.col("a") + 1, F.length(w) - F.col("a") - F.col("b")) for w in ("word", "near")]
    return first & last & (F.levenshtein(*open_, 1) == 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words that differ by exactly one code point. ``words`` has (word, n), words once."""
    side = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1), F.lit(2))).alias("as"))
    # as 2 a word gives chunks; else it gives grams for words of -1, 0 or 1 code points more
    side = side.select("word", "n", (F.col("as") == 2).alias("chunk"), (F.length("word") + F.when(F.col("as") == 2, 0).otherwise(F.col("as"))).alias("l"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    rows = stored(_cut(side.where("l > 1")), "chunks")
    found = None
    while True:
        sizes = rows.groupBy("key").agg(F.count_if("chunk").alias("chunks"), F.count_if(~F.col("chunk")).alias("grams"), F.max(F.col("l") - F.col("a") - F.col("b")).alias("open")).where("chunks > 0 AND grams > 0")
        met = stored(rows.join(sizes, "key"), "met-chunks")
        refined = (F.greatest("chunks", "grams") > SHARED) & (F.col("open") > 1)
        pairs = met.where(~refined)
        left = pairs.where("chunk").select("key", "word", "n", "a", "b")
        right = pairs.where("NOT chunk").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
        near = left.join(right, "key").where(_one_edit()).select("word", "n", "near", "near_n")
        found = near if found is None else found.union(near)
        hot = met.where(refined).select("word", "n", "chunk", "l", "a", "b")
        if hot.isEmpty():
            return found.distinct()
        rows = stored(_cut(hot), "chunks")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of forms end. ``forms`` has (word, form) of words that have one; each step doubles the way gone, and
    ways end as a form occurs more often than its word."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = stored(ways.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "ways")
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return ways


def variants(docs: DataFrame, typo: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word: word, n, n_near, form, form_n, root.

    Words are maximal runs of Latin letters, A to Z in lower case, with at least LENGTH code points and COUNT occurrences. Two are near
    if exactly one inserted, deleted or replaced code point makes one the other. A word's form is its most frequent near word (of
    ties the first in the order of code points), if that occurs RATIO times as often; its root is the last of the forms' forms, or the
    word. Null and empty texts have no words; very long texts and runs are taken whole; repeated rows count again; a null id counts as
    empty text in ``typo``'s hash. Other columns are left out, whatever their names. An empty table gives an empty result.
    """
    words = stored(vocabulary(docs, typo, id_col, text_col), "vocabulary")
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w")))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    whole = words.join(near, "word", "left").withColumn("taken", F.coalesce(F.col("best.near_n") >= RATIO * F.col("n"), F.lit(False)))
    whole = stored(whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("taken"), F.col("best.near")).alias("form"), F.when(F.col("taken"), F.col("best.near_n")).alias("form_n")), "variants")
    ends = roots(whole.where("form IS NOT NULL"))
    return whole.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
