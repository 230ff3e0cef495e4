"""Scores, labels and enrichment of records as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from derlem.functions.text import number_key

#: Types of legislation by words of their title, the first that fits counts.
TYPES = (("anayasa", "ANAYASA"), ("kanun hükmünde kararname", "KHK"), ("cumhurbaşkanlığı kararnamesi", "CBK"), ("yönetmeli", "YONETMELIK"), ("yonetmeli", "YONETMELIK"), ("tebliğ", "TEBLIG"), ("teblig", "TEBLIG"), ("tüzü", "TUZUK"), ("kanun", "KANUN"))
#: Chambers there are, by rule.
CHAMBERS = [*(f"{i}. {k} Dairesi" for k in ("Hukuk", "Ceza") for i in range(1, 24)), *(f"{i}. Daire" for i in range(1, 18))]
#: Content states with whether text is at hand and how sure that is.
STATES = {"full_text": ("available", "high"), "html_markdown": ("available", "medium"), "pdf_link_only": ("link", "low"), "metadata_only": ("metadata", "low"), "unavailable": ("none", "none")}


def rerank(score: Column, usable: Column, age_days: Column) -> Column:
    """A score with a bonus for usable and recent records; an unknown age gives none."""
    boost = F.when(usable, 0.05).otherwise(0.0) + F.coalesce(0.02 / (1 + F.greatest(age_days, F.lit(0)) / 1825), F.lit(0.0))
    return F.bround(score + F.bround(boost, 4), 6)


def metadata_match(a: dict[str, Column], b: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted share of the fields named on the left that agree; 0 where none is named."""
    got = total = F.lit(0.0)
    for f, w in weights.items():
        x, y = F.lower(F.trim(a[f])), F.lower(F.trim(b[f]))
        total = total + F.when(a[f].isNotNull(), w).otherwise(0.0)
        got = got + F.when(x == y, w).otherwise(0.0)
    return F.when(total > 0, got / total).otherwise(F.lit(0.0))


def classify_type(title: Column) -> Column:
    t = F.lower(F.translate(F.coalesce(title, F.lit("")), "İI", "iı"))
    out = F.when(t.contains(TYPES[0][0]), TYPES[0][1])
    for word, kind in TYPES[1:]:
        out = out.when(t.contains(word), kind)
    return out.otherwise("DIGER")


def enrich_status(df: DataFrame) -> DataFrame:
    """``availability`` and ``text_confidence`` of each content status; unknown ones count as none."""
    pick = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in STATES.items() for x in (k, v[i])]), F.col("content_status")), F.lit("none"))
    return df.withColumns({"availability": pick(0), "text_confidence": pick(1)})


def preference(source: str, preferred: list[str]) -> Column:
    """The place of a source among the preferred ones; all others come after them."""
    at = F.array_position(F.array(*map(F.lit, preferred)), F.col(source))
    return F.when(at > 0, at).otherwise(F.lit(2**31))


def route(sources: DataFrame, name: str, caps: str, wanted: list[str], preferred: list[str] = (), excluded: list[str] = ()) -> DataFrame:
    """(name, rank) of the sources (one row each) that have every capability wanted; ties go by name."""
    fit = sources.filter(F.forall(F.array(*map(F.lit, wanted)), lambda w: F.array_contains(caps, w)) & ~F.col(name).isin(*excluded))
    return fit.select(name, F.row_number().over(Window.orderBy(preference(name, list(preferred)), name)).cast("long").alias("rank"))


def carry_over(new: DataFrame, old: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``new`` with its empty ``fields`` filled from ``old`` (one row per key)."""
    o = old.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    j = new.join(o, keys, "left")
    return j.withColumns({f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_{f}")) for f in fields}).drop(*[f"_{f}" for f in fields])


def overlap_bucket(shared: Column, union: Column) -> Column:
    """The bucket of two sets by the sizes of their intersection and union; two empty ones share nothing."""
    s = F.when(union > 0, shared / union).otherwise(F.lit(0.0))
    return F.when(s >= 0.3, "strong").when(s >= 0.1, "weak").otherwise("none")


def vocabulary_overlap(docs: DataFrame, group: str, toks: Column) -> DataFrame:
    """(a, b, bucket) of every two groups, a before b, by the words that their texts have in common.

    Words are counted by the set of groups that have them, so only those sets, as wide as there are groups, meet in pairs.
    """
    words = docs.select(group, F.explode(toks).alias("w")).distinct()
    sets = words.groupBy("w").agg(F.sort_array(F.collect_set(group)).alias("gs")).groupBy("gs").agg(F.count("*").alias("n"))
    size = sets.select(F.explode("gs").alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))
    one = sets.filter(F.size("gs") > 1).select("gs", "n", F.posexplode("gs").alias("i", "a"))
    shared = one.select("a", "n", F.explode(F.slice("gs", F.col("i") + 2, F.size("gs"))).alias("b")).groupBy("a", "b").agg(F.sum("n").alias("shared"))
    g = docs.select(F.col(group).alias("g")).distinct().join(size, "g", "left").select("g", F.coalesce("n", F.lit(0)).alias("n"))
    pairs = g.toDF("a", "n_a").join(g.toDF("b", "n_b"), F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return pairs.select("a", "b", overlap_bucket(F.col("shared"), F.col("n_a") + F.col("n_b") - F.col("shared")).alias("bucket"))


def hash_embedding(df: DataFrame, key: str, toks: Column, dims: int = 128) -> DataFrame:
    """(key, axis, x): words at weight 1.5 and the trigrams of long words at 0.35, hashed to signed axes, of length 1 together.

    The axis is given by the first seven hex digits of SHA-256, the sign by the parity of the eighth.
    """
    w = df.select(key, F.explode(toks).alias("w"))
    tri = w.filter(F.length("w") >= 5).select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))).alias("w"), F.lit(0.35).alias("x"))
    parts = w.select(key, "w", F.lit(1.5).alias("x")).unionByName(tri)
    h = F.sha2(F.encode("w", "utf-8"), 256)
    axis = F.pmod(F.conv(F.substring(h, 1, 7), 16, 10).cast("long"), F.lit(dims)).cast("int")
    sign = F.when(F.conv(F.substring(h, 8, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    one = parts.select(key, axis.alias("axis"), (sign * F.col("x")).alias("x")).groupBy(key, "axis").agg(F.sum("x").alias("x"))
    n = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return one.select(key, "axis", (F.col("x") / F.greatest(n, F.lit(1e-12))).alias("x"))


def first_candidates(citing: DataFrame, records: DataFrame, k: int = 20) -> DataFrame:
    """Up to ``k`` records per citation that share a number, in the corpus's order.

    ``citing``: cid, esas, karar. Two equi-joins replace a join over alternatives.
    """
    from pyspark.sql import Window

    r = records.select("row_id", number_key("esas_no").alias("e"), number_key("karar_no").alias("n"))
    c = citing.select("cid", number_key("esas").alias("ce"), number_key("karar").alias("ck"))
    both = c.join(r, c.ce == r.e).select("cid", "row_id").union(c.join(r, c.ck == r.n).select("cid", "row_id")).distinct()
    return both.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("row_id"))).filter(F.col("r") <= k)


def mine(df: DataFrame, key: str, text: Column, says: dict[str, str], shortest: int = 100) -> DataFrame:
    """(key, n_holdings, has_ratio, has_dispute) of the texts above ``shortest``, by patterns over their paragraphs; up to three holdings count, and the dispute stands within the first ten."""
    t = F.coalesce(text, F.lit(""))
    paras = F.filter(F.transform(F.split(t, "\n\n"), lambda p: F.trim(p, F.lit(" \n\r\t"))), lambda p: p != "")
    low = F.transform(paras, lambda p: F.lower(F.translate(p, "İI", "iı")))
    x = df.filter(F.length(t) >= shortest).select(key, F.explode(F.array(low)).alias("ps")).filter(F.size("ps") > 0)
    hits = lambda k, ps: F.size(F.filter(ps, lambda p: p.rlike(says[k])))
    return x.select(key, F.least(hits("holding", F.col("ps")), F.lit(3)).cast("long").alias("n_holdings"), (hits("ratio", F.col("ps")) > 0).alias("has_ratio"), (hits("dispute", F.slice("ps", 1, 10)) > 0).alias("has_dispute"))


def citation_match(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How well a citation (court, chamber, esas, karar, dt) fits a record: what agrees of what both name, weighted 3, 2, 3, 3, 2.

    Courts agree if one name contains the other, else they count a sixth; numbers that contain each other count two thirds.
    """
    both = lambda f: a[f].isNotNull() & b[f].isNotNull()
    within = lambda x, y: y.contains(x)
    la, lb = {f: F.lower(c) for f, c in a.items()}, {f: F.lower(c) for f, c in b.items()}
    got = [
        F.when(both("court"), F.when(within(la["court"], lb["court"]) | within(lb["court"], la["court"]), 3.0).otherwise(0.5)),
        F.when(both("chamber") & within(la["chamber"], lb["chamber"]), 2.0),
        *[F.when(both(f), F.when(a[f] == b[f], 3.0).when(within(a[f], b[f]) | within(b[f], a[f]), 2.0)) for f in ("esas", "karar")],
        F.when(a["dt"] == b["dt"], 2.0),
    ]
    add = lambda cs: sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    total = add([F.when(both(f), w) for f, w in (("court", 3.0), ("chamber", 2.0), ("esas", 3.0), ("karar", 3.0), ("dt", 2.0))])
    return F.when(total > 0, add(got) / total).otherwise(F.lit(0.0))
