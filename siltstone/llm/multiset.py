"""Homomorphic multiset fingerprints of documents, with DataFrame operations only.

A paragraph is a line. Each paragraph hashes to a wide vector and the document's fingerprint is the lane-wise sum, so it does
not depend on the paragraphs' order, and a paragraph is inserted or deleted by adding or subtracting its vector (``plus``,
``minus``). The vector has DENSE lanes modulo 2**32 of the whole paragraph (512 bits, for equality) and 180 lanes that count, over
all overlapping runs of RUN tokens in the paragraph, how often a bit of the run's hash is set; twice those less the runs'
number is a random projection of the multiset of runs, whose cosine gives the likeness of two documents. A paragraph of
fewer tokens is one run. Tokens are words; one of over LONGEST characters counts by its pieces of LONGEST characters, or of one
character in scripts without spaces. Three counting lanes of 20 bits lie in a long.

Runs are exploded and their lanes summed by one hash aggregate, in the partitioning that the window over neighbouring
documents has made already: a text is shuffled once, and no fingerprint is.

Cases: a null text is an empty one (one empty paragraph, no runs). Likeness is 1 for equal fingerprints, else 0 when either
has no runs, else the cosine held between 0 and 1. Rows with equal ids stand in the order of their texts' hashes; null ids come
first. One row is its own next. An empty table gives no rows. Extra columns are ignored. Beyond 2**21 runs in one text a
counting lane carries into its neighbour, which moves a likeness by less than a millionth and no equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import width

LANE = 0xFFFFF
ONES = 1 | 1 << 20 | 1 << 40
WORD = 0xFFFFFFFF
DENSE = 16
SKETCHES = 3
SHIFTS = 20
COUNTS = SKETCHES * SHIFTS
RUN, LONGEST = 4, 16
PIECE = r"[\u2E80-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF]|[^\s\u2E80-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF]{1,16}"


def _tokens(line: Column) -> Column:
    """Hashes of a line's tokens."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    pieces = F.flatten(F.transform(words, lambda w: F.when(F.length(w) <= LONGEST, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit(PIECE), F.lit(0)))))
    tokens = F.when(F.exists(words, lambda w: F.length(w) > LONGEST), pieces).otherwise(words)
    return F.transform(tokens, lambda t: F.xxhash64(t))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., fp) of every row, whose keys must tell it from all others: fp is array<long> of the runs' number, DENSE and COUNTS lanes."""
    lines = texts.select(*keys, F.explode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("_p"))
    hashed = lines.select(
        *keys,
        F.xxhash64(F.lit(0), "_p").alias("_g"),
        F.xxhash64(F.lit(1), "_p").alias("_h"),
        _tokens(F.col("_p")).alias("_t"),
    )
    # a token after the end is null, which the hash leaves out
    runs = F.transform(
        F.slice("_t", F.lit(1), F.greatest(F.size("_t") - (RUN - 1), F.lit(1))), lambda h, i: F.struct(F.xxhash64(h, *[F.get("_t", i + j) for j in range(1, RUN)]).alias("_h"), F.lit(None).cast("long").alias("_g"))
    )
    items = hashed.select(*keys, F.inline(F.concat(F.array(F.struct(F.col("_h"), F.col("_g"))), runs)))
    run = F.col("_g").isNull()
    mixed = items.select(
        *keys,
        F.when(run, 1).otherwise(0).cast("long").alias("_n"),
        *[F.when(run, F.lit(0).cast("long")).otherwise(F.xxhash64("_g", "_h", F.lit(j))).alias(f"_d{j}") for j in range(DENSE // 2)],
        *[F.when(run, F.xxhash64("_h", F.lit(j))).otherwise(F.lit(0).cast("long")).alias(f"_s{j}") for j in range(SKETCHES)],
    )
    lanes = [F.sum("_n")]
    for j in range(DENSE // 2):
        lanes += [F.sum(F.col(f"_d{j}").bitwiseAND(F.lit(WORD))), F.sum(F.shiftrightunsigned(f"_d{j}", 32))]
    lanes += [F.sum(F.shiftrightunsigned(f"_s{j}", k).bitwiseAND(F.lit(ONES))) for j in range(SKETCHES) for k in range(SHIFTS)]
    summed = mixed.groupBy(*keys).agg(*[x.alias(f"_l{i}") for i, x in enumerate(lanes)])
    fp = [F.col(f"_l{i}").bitwiseAND(F.lit(WORD)) if 1 <= i <= DENSE else F.col(f"_l{i}") for i in range(len(lanes))]
    return summed.select(*keys, F.array(*fp).alias("fp"))


def _dense(i: Column) -> Column:
    return (i >= 1) & (i <= DENSE)


def plus(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    both = F.zip_with(a, b, lambda x, y: x + y)
    return F.transform(both, lambda x, i: F.when(_dense(i), x.bitwiseAND(F.lit(WORD))).otherwise(x))


def minus(a: Column, b: Column) -> Column:
    """Fingerprint of a's paragraphs without b's."""
    both = F.zip_with(a, b, lambda x, y: x - y)
    return F.transform(both, lambda x, i: F.when(_dense(i), x.bitwiseAND(F.lit(WORD))).otherwise(x))


def digits(fp: Column) -> Column:
    """Hex digits of a fingerprint."""
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def sketch_of(fp: Column) -> Column:
    """array<double>: the signed lanes of likeness."""
    n = fp[0]
    lanes = F.flatten(
        F.transform(
            F.slice(fp, DENSE + 2, COUNTS),
            lambda x: F.array(x.bitwiseAND(F.lit(LANE)), F.shiftrightunsigned(x, 20).bitwiseAND(F.lit(LANE)), F.shiftrightunsigned(x, 40)),
        )
    )
    return F.transform(lanes, lambda c: (c * 2 - n).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _likeness(fp_a: Column, fp_b: Column, a: Column, b: Column) -> Column:
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(_dot(a, b), norm)))
    return F.when(fp_a == fp_b, F.lit(1.0)).otherwise(F.coalesce(cosine, F.lit(0.0)))


def _with_next(rows: DataFrame, order: str, tie: str, carried: list[str]) -> DataFrame:
    """``rows`` with ``next``, a struct of the carried columns of the row that follows in ascending order (after the last: the first).

    Ranges of the order, four a shuffle partition, take one window each. Each range (_b) also gets the first row of the next
    one as a guest (_guest 1), which is left in the result; _at is a row's place in its range. So there is no window over
    everything. Only the ranges' bounds reach the driver.
    """
    spark = rows.sparkSession
    parts = min(4 * width(spark), 8192)
    keys = rows.select(order)
    cuts = keys.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    bounds = sorted(set(cuts or []))
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    if bounds:
        lit = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
        jumps = F.split(F.lit(",".join(map(str, steps))), ",").cast("array<int>")
        bucket = F.aggregate(jumps, F.lit(0), lambda i, s: F.when(F.coalesce(F.get(lit, i + s - 1) <= F.col(order), F.lit(False)), i + s).otherwise(i))
    else:
        bucket = F.lit(0)
    least = {r["k"]: r["m"] for r in keys.select(bucket.alias("k"), order).groupBy("k").agg(F.min(order).alias("m")).collect()}
    full = sorted(least)
    first = {k: least[k] for k in full}
    guest_of = {k: full[i - 1] for i, k in enumerate(full)}
    size = len(bounds) + 1
    minimum = F.split(F.lit(",".join(str(first.get(k, 0)) for k in range(size))), ",").cast("array<long>")
    back = F.split(F.lit(",".join(str(guest_of.get(k, 0)) for k in range(size))), ",").cast("array<int>")
    at = F.col("_bucket") + 1
    homes = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest")))
    guests = F.when(F.col(order) == F.element_at(minimum, at), F.array(F.struct(F.element_at(back, at).alias("b"), F.lit(1).alias("guest"))))
    placed = rows.withColumn("_bucket", bucket).withColumn("_home", F.explode(F.concat(homes, F.coalesce(guests, F.array().cast("array<struct<b:int,guest:int>>")))))
    # a partition a range; the number is given, for adaptive execution would merge them by their bytes, not by the work on them
    flat = placed.select(F.col("_home.b").alias("_b"), F.col("_home.guest").alias("_guest"), *rows.columns).repartitionById(size, F.col("_b"))
    w = Window.partitionBy("_b").orderBy("_guest", order, tie)
    return flat.withColumn("_at", F.row_number().over(w)).withColumn("next", F.lead(F.struct(*carried)).over(w))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, text, edited) of every text, with _b, _at and _guest.

    The edit replaces the last floor(n_chars / 2) code points by the first as many (or all) of the next document's text. Rows
    with _guest 1 stand for the first row of the next range and are no results.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("_order"), F.xxhash64("text").alias("_tie"), "text"
    )
    paired = _with_next(rows, "_order", "_tie", ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next.text", F.lit("")), F.lit(1), half))
    return paired.select("_b", "_at", "_guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))


def edited_fingerprints(docs: DataFrame, keep: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, keep..., fp, edited_fp, near_edited, near_next): every text against its edit and the next document's text.

    keep: small columns derived from ``text`` and ``edited``, such as a digest; they travel with every run of words.
    """
    both = F.posexplode(F.array(F.struct(F.col("text").alias("body")), F.struct(F.col("edited").alias("body"))))
    kept = [v.alias(k) for k, v in keep.items()]
    pairs = edits(docs, id_col, text_col).select("_b", "_at", "_guest", "doc_id", "n_chars", *kept, both.alias("_which", "_t"))
    keys = ["_b", "_at", "_which", "_guest", "doc_id", "n_chars", *keep]
    fps = fingerprints(pairs.select(*keys, F.col("_t.body").alias("_body")), keys, "_body")
    # in a range: a text, its edit, the next text, its edit, ...
    w = Window.partitionBy("_b").orderBy("_at", "_which")
    ahead = fps.select("*", F.lead("fp", 1).over(w).alias("edited_fp"), F.lead("fp", 2).over(w).alias("_next")).where("_which = 0 and _guest = 0")
    lanes = ahead.select("*", sketch_of(F.col("fp")).alias("_x"), sketch_of(F.col("edited_fp")).alias("_y"), sketch_of(F.col("_next")).alias("_z"))
    return lanes.select(
        "doc_id",
        "n_chars",
        *keep,
        "fp",
        "edited_fp",
        _likeness(F.col("fp"), F.col("edited_fp"), F.col("_x"), F.col("_y")).alias("near_edited"),
        _likeness(F.col("fp"), F.col("_next"), F.col("_x"), F.col("_z")).alias("near_next"),
    )
