"""SpotSigs: texts as sets of signatures, each a common word (anchor) and the content words that follow it.

Anchors sit in prose and hardly in menus or lists, so their chains fingerprint the prose. All of it is
built-in functions: anchors are marked by one replacement, the text is cut at the marks, and each piece,
continued by the next ones where it is short, gives one signature hash. Between texts, sets are compared
by Jaccard similarity within partitions of like set length, over the rarest signatures only.

Words far from any anchor stand for themselves. A text that gives nothing so is described by its words, one
without letters by itself, an empty or null one by the empty set; two empty sets are alike (1), an empty and
another are not (0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.session import materialize

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auf das dem den der des die ein eine im ist mit nicht sich und von zu "
    "au aux ce dans du elle est et il la le les ne par pas pour que qui sur un une "
    "al como con de del el en es lo los las no para por se su y"
).split()


def signatures(text: Column, chain: int = 2, anchors: tuple[str, ...] | list[str] = tuple(ANCHORS), reach: int = 8) -> Column:
    """Sorted distinct 64-bit signatures of a text: anchor and the next ``chain`` content words.

    Words more than ``reach`` places from the anchor before them (lists, tables) are signatures themselves.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    choice = "|".join(sorted(set(anchors)))
    marked = F.regexp_replace(F.concat(F.lit(". "), plain, F.lit(" ")), f" ({choice})(?= )", "\n$1")
    pieces = F.split(F.rtrim(marked), "\n", -1)

    def found(all_pieces: Column) -> Column:
        content = F.filter(F.slice(all_pieces, 2, F.greatest(F.size(all_pieces) - 1, F.lit(0))), lambda p: F.instr(p, " ") > 0)
        near = lambda p: F.substring_index(p, " ", reach + 1)
        long = F.filter(all_pieces, lambda p: F.length(near(p)) < F.length(p))
        far = F.flatten(F.transform(long, lambda p: F.split(F.substring(p, F.length(near(p)) + 2, F.length(p)), " ")))
        return F.concat(F.get(F.transform(F.array(content), chained), 0), F.transform(far, lambda w: F.xxhash64(w)))

    def chained(content: Column) -> Column:
        after = lambda i: F.substring(F.get(content, i), F.instr(F.get(content, i), " ") + 1, F.length(F.get(content, i)))
        words = lambda p, i: F.concat_ws(" ", p, *[after(i + k) for k in range(1, chain)])
        return F.transform(content, lambda p, i: F.xxhash64(F.substring_index(words(p, i), " ", chain + 1)))

    from_words = F.transform(F.split(plain, " "), lambda w: F.xxhash64(w))
    nothing = F.array().cast("array<bigint>")
    other = F.when(plain != "", from_words).when(text != "", F.array(F.xxhash64(text))).otherwise(nothing)
    # Binding a value to a lambda variable evaluates it once per row.
    sigs = F.get(F.transform(F.array(pieces), found), 0)
    sigs = F.get(F.transform(F.array(sigs), lambda s: F.when(F.size(s) > 0, s).otherwise(other)), 0)
    return F.sort_array(F.array_distinct(sigs))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def as_text(sigs: Column) -> Column:
    """The set as text: equal sets, and so equal texts, give equal fingerprints."""
    return F.array_join(sigs.cast("array<string>"), " ")


def with_next(rows: DataFrame, carried: list[str], bucket_rows: int = 4096) -> DataFrame:
    """Adds next_<column> of the following row in descending ``id`` order (after the last row: the first).

    Null ids come last, ties go by the hash of the text. Ids are cut at quantiles and evenly between them
    into buckets of about ``bucket_rows`` rows; a window runs inside each, and the first row of each bucket
    is also put at the end of the one before it, so that no window spans the table.
    """
    order = rows.withColumn("_tie", F.xxhash64("text"))
    parts = [i / 64 for i in range(1, 64)]
    n, low, high, cuts = order.agg(F.count("*"), F.min("id"), F.max("id"), F.percentile_approx("id", parts, 10000)).first()
    bits = max(0, math.ceil(math.log2(max(n, 1) / bucket_rows / 64 + 1)))
    bounds = sorted({low or 0, *(cuts or [])})
    edges = F.array(*[F.lit(x).cast("long") for x in [*bounds, (high or 0) + 1]])
    at = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in bounds]), lambda c: c <= F.col("id")))
    share = (F.col("id") - F.get(edges, F.col("_at") - 1)) / (F.get(edges, F.col("_at")) - F.get(edges, F.col("_at") - 1))
    fine = F.least(F.floor(share * 2**bits), F.lit(2**bits - 1))
    hashed = F.shiftrightunsigned(F.col("_tie").bitwiseXOR(F.lit(-(2**63))), 64 - bits - 1) - 2 ** (bits + 1)
    bucket = F.when(F.col("id").isNull(), hashed).otherwise(F.col("_at") * 2**bits + fine)
    cut = order.withColumn("_at", at).withColumn("_bucket", bucket.cast("long")).drop("_at")

    firsts = cut.groupBy("_bucket").agg(F.max(F.struct("id", "_tie")).alias("_first"))
    firsts = materialize(firsts.select("_bucket", "_first.*"), "bucket_firsts")
    across = Window.orderBy(F.col("_bucket").desc())
    back = F.coalesce(F.lag("_bucket").over(across), F.min("_bucket").over(Window.partitionBy(F.lit(0))))
    ends = firsts.select(F.col("_bucket").alias("_own"), "id", "_tie", back.alias("_to"))
    copies = cut.join(ends.withColumnsRenamed({"id": "_id", "_tie": "_t"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t")) & (F.col("_bucket") == F.col("_own")))
    copies = copies.dropDuplicates(["_bucket"]).withColumn("_bucket", F.col("_to")).drop("_own", "_id", "_t", "_to")
    whole = cut.withColumn("_copy", F.lit(0)).unionByName(copies.withColumn("_copy", F.lit(1)))
    inside = Window.partitionBy("_bucket").orderBy("_copy", F.col("id").desc_nulls_last(), F.col("_tie").desc())
    found = whole.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in carried])
    return found.where("_copy = 0").drop("_copy", "_bucket", "_tie")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness to each other and to the next text.

    The edit replaces the last third of the code points (rounded down) by as many of the next document's.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("sigs", signatures(F.col("text")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    pairs = with_next(rows, ["text", "sigs"]).select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    pairs = pairs.withColumn("edited_sigs", signatures(F.col("edited")))
    return pairs.select(
        "id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sigs")).alias("fingerprint"),
        as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """((a, b, similarity) between signature sets, (id, set_id) of every row with a signature).

    Rows of equal sets share a set_id, the least id, and are compared once. A set of n signatures shows only
    its n - ceil(similarity * n) + 1 rarest: two sets that alike share one of those. Sets are dealt out by
    signature and length class (powers of 1 / similarity); those of like length are in the same or the next
    class, and lengths too far apart are dropped before the sets are compared.
    """
    rows = docs.select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("sigs"))
    rows = materialize(rows.where(F.size("sigs") > 0).withColumn("key", F.sha2(as_text(F.col("sigs")).cast("binary"), 256)), "sets")
    least = materialize(rows.groupBy("key").agg(F.min("id").alias("set_id")), "set_ids")
    members = rows.join(least, "key").select("id", "set_id")
    sets = materialize(rows.dropDuplicates(["key"]).join(least, "key").select("set_id", "sigs", F.size("sigs").alias("n")), "distinct_sets")
    long = sets.select("set_id", "n", F.explode("sigs").alias("sig"))
    counts = materialize(long.groupBy("sig").agg(F.count("*").alias("df")), "signature_counts")
    ranked = long.join(counts, "sig").groupBy("set_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("s"))
    shown = F.col("n") - F.ceil(F.col("n") * similarity).cast("int") + 1
    length_class = F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity)).cast("int")
    prefix = materialize(ranked.select("set_id", "n", length_class.alias("c"), F.explode(F.slice("s", F.lit(1), shown)).alias("x")).select("set_id", "n", "c", F.col("x.sig").alias("sig")), "prefixes")
    left = prefix.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), "sig", F.explode(F.array("c", F.col("c") + 1)).alias("c"))
    met = left.join(prefix.withColumnsRenamed({"set_id": "b", "n": "n_b"}), ["sig", "c"])
    like = (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") >= F.col("n_b") * similarity) & ((F.col("n_a") < F.col("n_b")) | (F.col("a") < F.col("b")))
    pairs = materialize(met.where(like).select("a", "b").distinct(), "candidates")
    one, two = (sets.select(F.col("set_id").alias(k), F.col("sigs").alias(f"sigs_{k}")) for k in "ab")
    compared = pairs.join(one, "a").join(two, "b").select("a", "b", likeness(F.col("sigs_a"), F.col("sigs_b")).alias("similarity"))
    return compared.where(F.col("similarity") >= similarity), members
