"""I-Match fingerprints: hashes of the terms in a band of document frequency, by randomised lexicon subsets.

Terms whose share of the distinct documents (by their sets of terms) lies in [low, high] are the lexicon, so that copies
move no term out of the band. A text of which the lexicon covers little, as in a large group of near copies, is hashed over all its terms. Since a share is at least `low`, there are at most
(mean number of distinct terms per text) / low of them, however large the corpus is: it is broadcast behind a check
of that size. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Share of the documents that a lexicon term is in, at least and at most.
LOW, HIGH = 0.001, 0.2
#: A text with a smaller share of its terms in the lexicon has its subsets taken from all its terms.
COVER = 0.25
#: A random lexicon subset holds one term in so many (powers of two: sparse ones outlive edits of long texts, dense
#: ones tell short texts apart), and the bit of the term's hash from which membership is read: four subsets of each.
RATES = (16, 32, 64, 128, 256, 512)
SUBSETS = tuple((rate, shift) for rate in RATES for shift in (0, 14, 28, 42))
#: Lexicon terms, or sets of terms with copies, that may be broadcast; beyond, the join shuffles.
MOST_BROADCAST = 2_000_000


def terms(text: Column) -> Column:
    """The distinct terms of a text: runs of letters and digits, lower case."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def distinct_texts(docs: DataFrame, id_col: str, text_col: str, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, int]:
    """The rows of docs whose id is the smallest of those with their set of terms, and their number. docs must have unique
    ids. Only hashes are grouped; texts are shuffled just where more than most_broadcast sets have copies."""
    key = F.xxhash64(F.sort_array(F.array_remove(terms(F.col(text_col)), "")))
    sets = written(docs.select(key.alias("__k"), id_col).groupBy("__k").agg(F.min(id_col).alias("__first"), F.count("*").alias("__n")))
    copied = sets.where("__n > 1").select("__k", "__first")
    if copied.count() <= most_broadcast:
        kept = docs.withColumn("__k", key).join(F.broadcast(copied), "__k", "left").where(F.col("__first").isNull() | (F.col("__first") == F.col(id_col)))
    else:
        kept = docs.join(sets.select(F.col("__first").alias(id_col)), id_col, "left_semi")
    return kept.select(*docs.columns), sets.count()


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH, id_col: str = "id") -> tuple[DataFrame, bool]:
    """(t long) hashes of the terms in the band, and whether they are few enough to broadcast. The counts cover all rows of
    docs, whose ids must be unique; rows with one set of terms count once."""
    once, rows = distinct_texts(docs, id_col, text_col)
    words = once.select(F.explode(terms(F.col(text_col))).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    band = written(words.where((F.col("n") >= low * rows) & (F.col("n") <= high * rows)).select(F.xxhash64("w").alias("t")).distinct())
    return band, band.count() <= MOST_BROADCAST


def _hashed(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.substring(F.sha2(F.array_join(x.cast("array<string>"), ","), 256), 1, 16)).otherwise("0")


def _members(ts: str, rate: int, shift: int) -> Column:
    return F.filter(ts, lambda t: F.shiftright(t, shift).bitwiseAND(F.lit(rate - 1).cast("long")) == 0)


def _with_hashes(rows: DataFrame, sets: dict[str, Column], texts: dict[str, Column]) -> DataFrame:
    """rows with <name>_fp for each name of sets (its lexicon terms) and texts; where the lexicon covers less than COVER of
    a text's terms, these are taken instead. Each step is its own projection, so that
    a set is sorted once; the subsets of one shift nest, so the sparser ones are taken from the densest."""
    least = min(RATES)
    shifts = sorted({shift for _, shift in SUBSETS})
    split = rows.withColumns({f"__{c}_w": F.array_remove(terms(texts[c]), "") for c in sets})
    few = {c: F.coalesce(F.size(x), F.lit(0)) < COVER * F.size(f"__{c}_w") for c, x in sets.items()}
    chosen = split.withColumns({f"__{c}_few": few[c] for c in sets})
    chosen = chosen.withColumns({f"__{c}": F.sort_array(F.when(F.col(f"__{c}_few"), F.transform(f"__{c}_w", lambda w: F.xxhash64(w))).otherwise(F.coalesce(x, F.array().cast("array<bigint>")))) for c, x in sets.items()})
    sorted_ = chosen.drop(*[f"__{c}_w" for c in sets])
    dense = sorted_.withColumns({f"__{c}_{s}": _members(f"__{c}", least, s) for c in sets for s in shifts})
    made = {}
    for c in sets:
        plain = F.substring(F.sha2(F.array_join(F.sort_array(terms(texts[c])), " "), 256), 1, 16)
        parts = [_hashed(_members(f"__{c}_{s}", r, s) if r > least else F.col(f"__{c}_{s}")) for r, s in SUBSETS]
        made[f"{c}_fp"] = F.concat_ws("-", F.when((F.size(f"__{c}") > 0) & ~F.col(f"__{c}_few"), _hashed(F.col(f"__{c}"))).otherwise(plain), *parts)
    return dense.withColumns(made)


def fingerprints(docs: DataFrame, band: DataFrame, small: bool, id_col: str, text_cols: list[str]) -> DataFrame:
    """docs with one fingerprint column <text column>_fp per text column: hex hashes joined by '-', one per lexicon subset: the
    sorted distinct terms of the text in that subset, hashed; '0' where there are none. The first is over the
    whole lexicon. For a text with less than COVER of its terms in the lexicon, all hashes are over all its terms. docs must have unique ids."""
    found = docs.select(F.col(id_col).alias("__id"), F.posexplode(F.array(*text_cols)).alias("__which", "__text"))
    found = found.select("__id", "__which", F.explode(terms(F.col("__text"))).alias("w")).select("__id", "__which", F.xxhash64("w").alias("t"))
    kept = found.join(F.broadcast(band) if small else band, "t").groupBy("__id").agg(
        *[F.collect_set(F.when(F.col("__which") == i, F.col("t"))).alias(f"__t{i}") for i in range(len(text_cols))]
    )
    joined = docs.join(kept, docs[id_col] == F.col("__id"), "left")
    made = _with_hashes(joined, {c: F.col(f"__t{i}") for i, c in enumerate(text_cols)}, {c: F.coalesce(F.col(c), F.lit("")) for c in text_cols})
    return made.select(*docs.columns, *[f"{c}_fp" for c in text_cols])


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets in which either text has terms, the share on which both hashes agree; 1 for equal fingerprints,
    0 where no subset has terms. Null where either is null."""
    pairs = F.arrays_zip(F.split(a, "-").alias("a"), F.split(b, "-").alias("b"))
    some = F.filter(pairs, lambda p: (p["a"] != "0") | (p["b"] != "0"))
    same = F.filter(some, lambda p: p["a"] == p["b"])
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, F.lit(1.0)).otherwise(F.size(same) / F.size(some))


def next_ids(ids: DataFrame, bucket_rows: int = 100_000) -> DataFrame:
    """ids (id, n) with the next id, ascending (after the last: the first), and the previous row's n.

    Spark's range partitioning cuts the order into ranges of about bucket_rows rows, written with their numbers; each range is
    a window of its own, and the ranges' first and last rows are tied in a table of one row per range."""
    cuts = max(1, ids.count() // bucket_rows)
    cut = written(ids.repartitionByRange(cuts, "id").withColumn("r", F.spark_partition_id()))
    w = Window.partitionBy("r").orderBy("id")
    inner = cut.withColumn("next", F.lead("id").over(w)).withColumn("prev", F.lag("id").over(w)).withColumn("prev_n", F.lag("n").over(w))
    ends = cut.groupBy("r").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max_by("n", "id").alias("hi_n"))
    v = Window.partitionBy(F.lit(0)).orderBy("r")  # one row per range
    ends = ends.select("r", F.lead("lo").over(v).alias("next_lo"), F.lag("hi").over(v).alias("prev_hi"), F.lag("hi_n").over(v).alias("prev_hi_n"))
    lo, hi, hi_n = ids.agg(F.min("id"), F.max("id"), F.max_by("n", "id")).first()
    lit = lambda x: F.lit(x).cast("long")
    return inner.join(F.broadcast(ends), "r").select(
        "id", "n", F.coalesce("next", "next_lo", lit(lo)).alias("next"), F.coalesce("prev", "prev_hi", lit(hi)).alias("prev"), F.coalesce("prev_n", "prev_hi_n", lit(hi_n)).alias("prev_n"),
    )


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last floor(n/4) code points replaced by the first as many,
    or all, of the next document's by ascending id; after the last comes the first), and both likenesses.

    Null texts are empty. Of rows with one id the smallest text counts, once; null ids are left out, having no place in
    the order. Terms are counted over all documents, copies of a set of terms once. Other columns are not read."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    sizes = docs.select("id", F.length("text").cast("long").alias("n"))
    if sizes.select("id").distinct().count() < sizes.count():
        docs = docs.groupBy("id").agg(F.min("text").alias("text"))
        sizes = docs.select("id", F.length("text").cast("long").alias("n"))
    order = written(next_ids(sizes))
    band, small = lexicon(docs, "text", low, high)
    # each text gives its start to the document before it
    heads = docs.join(order.select("id", "prev", F.floor(F.col("prev_n") / 4).cast("int").alias("k")), "id").select(F.col("prev").alias("id"), F.expr("left(text, k)").alias("head"))
    n = F.length("text")
    both = docs.join(heads, "id").select(
        "id", "text", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.col("head")).alias("edited")
    )
    made = written(
        fingerprints(both, band, small, "id", ["text", "edited"])
        .select("id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text_fp", "edited_fp")
    )
    following = order.select("id", "next").join(made.select(F.col("id").alias("next"), F.col("text_fp").alias("next_fp")), "next").select("id", "next_fp")
    return made.join(following, "id").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("text_fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("text_fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("text_fp"), F.col("next_fp")).alias("near_next"),
    )
