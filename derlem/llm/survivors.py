"""Best representative of each duplicate group, field by field.

Two parts share one set of records. ``survivors`` takes for every field the first member with a value
in a stated order of trust. ``latent_quality`` is the two-sided model: each distinct value of a field
is true or false, each source asserts true values with its sensitivity and false ones with one minus
its specificity; expectation-maximisation infers both, and how often a field's values are true, from
agreement alone. A member without a value for a field is silent: it neither asserts nor denies.
``judged_values`` keeps every value whose posterior reaches a threshold, so fields with several true
values retain them all. ``agreement`` counts how often the value it holds for most probable is the one
of the stated order.

Nothing but counts per source reaches the driver: claims are first grouped into signatures (which
sources assert a value, which another one), and each round sums expected counts per source on the
executors. The number of sources is that of the feeds that deliver records, and the quality is one per source and field.

Defined results: members that are in no record table, groups with one member left and fields
without any value give no row; repeated members and deliveries count once; null parts of the
order come last; ties go to the smaller document id, then the smaller source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from derlem.functions.keys import BLANKS, effective_text, fold_key, pair_key, strip
from derlem.operators.orphans import split_by_filter
from derlem.operators.timestamps import add_readings
from derlem.session import cut

#: Content states from most to least trusted.
STATES = ("full_text", "html_markdown", "pdf_link_only", "metadata_only", "unavailable")
SHORTEST = 50
FIELDS = ("title", "court", "chamber", "decision_date", "esas_no", "karar_no", "source_url", "full_text")


def trust_order(doc: str, source: str) -> Column:
    """A struct whose smallest value is the most trusted record."""
    text = F.coalesce(effective_text(), F.lit(""))
    length = F.length(strip(F.regexp_replace(text, f"[{BLANKS}]+", " ")))
    state = fold_key("content_status")
    short = F.length(strip(text)) < SHORTEST
    state = F.when(state.isin(*STATES[:2]) & short, STATES[3]).otherwise(state)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), state), F.lit(0))
    rank = F.when(rank == 0, len(STATES) + 1).otherwise(rank)
    late = F.coalesce(-F.unix_micros(F.col("retrieved_at").cast("timestamp")), F.lit(2**62))
    return F.struct(rank.cast("int").alias("state"), (-length).alias("len"), late.alias("late"), strip(doc).alias("document_id"), strip(source).alias("source"))


def group_records(clusters: DataFrame, members: DataFrame, docs: DataFrame, fields: tuple[str, ...] = FIELDS, *, values: bool = False) -> DataFrame:
    """One narrow row per delivered record of a group: cluster_id, key, order and, per field, whether it has a value.

    Texts are measured before the join and do not move. Only the dates of members are read. With ``values`` the fields come as
    structs (h, v) with the value, a full text's as its SHA-256, beside the hash of the form in which values compare.
    """
    number = lambda f: F.nullif(F.regexp_extract(f, r"(\d{4}\s*/\s*\d+)", 1), F.lit(""))  # noqa: E731  a case number, whatever stands around it
    value = lambda f: F.regexp_replace(F.lower(F.coalesce(number(f), strip(f)) if f in ("esas_no", "karar_no") else strip(f)), f"[{BLANKS}]+", "" if f in ("esas_no", "karar_no") else " ")
    has = lambda f: F.col(f).rlike(r"[\p{L}\p{N}]")
    shown = lambda f: F.sha2(F.encode(strip(f), "utf-8"), 256) if f == "full_text" else strip(f)
    cell = lambda f: F.struct(F.xxhash64(value(f)).alias("h"), shown(f).alias("v")) if values else F.lit(True)
    m = members.filter("cluster_id is not null and document_id is not null").select(fold_key("cluster_id").alias("ck"), pair_key("document_id", "source").alias("key")).distinct()
    # a filter of bounded size leaves out the records that are in no group before their texts are measured
    rec = split_by_filter(docs.filter("document_id is not null").withColumn("_key", pair_key("document_id", "source")), m.select(F.col("key").alias("_key")), "_key").filter("maybe").select(
        F.col("_key").alias("key"), trust_order("document_id", "source").alias("order"),
        *[F.col(f) if f == "decision_date" else F.when(has(f), cell(f)).alias(f) for f in fields],
    )
    c = clusters.filter("cluster_id is not null").groupBy(fold_key("cluster_id").alias("ck")).agg(F.min(strip("cluster_id")).alias("cluster_id"))
    got = m.join(c, "ck").join(rec, "key").drop("ck")
    if "decision_date" not in fields:
        return got
    # the day in Istanbul is the date's value, whatever its writing
    dated = add_readings(got, "decision_date")
    moment = F.xxhash64(F.from_utc_timestamp(F.timestamp_micros(F.element_at("readings", 1)["micros"]), "Europe/Istanbul").cast("date").cast("string"))
    day = F.struct(moment.alias("h"), strip("decision_date").alias("v")) if values else F.lit(True)
    return dated.withColumn("decision_date", F.when(has("decision_date") & (F.size("readings") > 0), day)).drop("readings")


def survivors(records: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(cluster_id, field_name, document_id, source) of the most trusted record with a value."""
    best = records.groupBy("cluster_id").agg(F.count_distinct("key").alias("n"), *[F.min(F.when(F.col(f).isNotNull(), F.col("order"))).alias(f) for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("o")) for f in fields]))
    return best.filter("n > 1").select("cluster_id", each.alias("x")).filter("x.o is not null").select("cluster_id", "x.field_name", "x.o.document_id", "x.o.source")


def claims(records: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(cluster_id, field_name, value, shown, holder, votes): per distinct value how many members of each source assert it and how many another.

    ``records`` with ``values``. ``holder`` is the most trusted record with the value. ``votes`` has an entry per source that
    says anything, whatever the number of members, so no group is collected however large it is.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("c")) for f in fields])).alias("x")
    src = F.coalesce(fold_key(F.col("order.source")), F.lit(""))
    place = ["cluster_id", "field_name"]
    said = records.select("cluster_id", "key", "order", src.alias("src"), each).select("cluster_id", "key", "order", "src", "x.field_name", "x.c.h", "x.c.v").filter("h is not null")
    by_source = said.groupBy(*place, "h", "src").agg(F.count_distinct("key").alias("yes"), F.min(F.struct("order", "v")).alias("o"))
    all_of = said.groupBy(*place, "src").agg(F.count_distinct("key").alias("n"))
    values = by_source.groupBy(*place, "h").agg(F.min("o").alias("o"))
    votes = values.join(all_of, place).join(by_source.select(*place, "h", "src", "yes"), [*place, "h", "src"], "left")
    yes = F.coalesce("yes", F.lit(0)).cast("int")
    vote = F.struct("src", yes.alias("yes"), (F.col("n") - yes).cast("int").alias("no"))
    got = votes.groupBy(*place, "h").agg(F.first("o").alias("o"), F.sort_array(F.collect_list(vote)).alias("votes"))
    return got.select(*place, F.col("h").alias("value"), F.col("o.v").alias("shown"), F.col("o.order").alias("holder"), "votes")


Quality = dict[tuple[str, str], tuple[float, float]]


def posterior(field: str, votes: list, q: Quality, prior: dict[str, float]) -> float:
    """Probability that a value is true, given the votes on it and the (sensitivity, specificity) of each source for the field."""
    p = prior.get(field, 0.5)
    a, b = np.log(p), np.log(1 - p)
    for v in votes:
        sens, spec = q[v["src"], field]
        a += v["yes"] * np.log(sens) + v["no"] * np.log(1 - sens)
        b += v["yes"] * np.log(1 - spec) + v["no"] * np.log(spec)
    return float(1 / (1 + np.exp(np.clip(b - a, -500, 500))))


def latent_quality(claim: DataFrame, rounds: int = 12, start: tuple[float, float] = (0.6, 0.95), weight: float = 10.0) -> tuple[Quality, dict[str, float]]:
    """Sensitivity and specificity per source and field, and per field the prior of truth.

    ``start`` is what is believed of a source before its claims are seen, with the weight of ``weight`` of them: false values
    are rarer than missing ones. Qualities are learned for each field apart: where members rightly have values of their own
    (an address, a text) the sensitivity comes out low, so that another value is no denial.
    """
    sig = cut(claim.groupBy("field_name", "votes").count())
    names = [(r["s"], r["field_name"]) for r in sig.select("field_name", F.explode("votes.src").alias("s")).distinct().collect()]
    q: Quality = dict.fromkeys(names, start)
    prior: dict[str, float] = {}
    for _ in range(rounds):

        def expect(batches: Iterator[pd.DataFrame], q: Quality = q, prior: dict = prior) -> Iterator[pd.DataFrame]:
            for b in batches:
                got: dict = {}
                for f, votes, n in zip(b["field_name"], b["votes"], b["count"]):
                    t = posterior(f, votes, q, prior)
                    for s, yes, no in [*((v["src"], v["yes"], v["no"]) for v in votes), (None, 1, 0)]:
                        x = got.setdefault((s, f), np.zeros(4))
                        x += n * np.array([t * yes, t * (yes + no), (1 - t) * no, (1 - t) * (yes + no)])
                yield pd.DataFrame([(s, f, *x) for (s, f), x in got.items()], columns=["s", "f", "tp", "true", "tn", "false"])

        sums = sig.mapInPandas(expect, "s string, f string, tp double, `true` double, tn double, `false` double").groupBy("s", "f").agg(*[F.sum(c).alias(c) for c in ("tp", "true", "tn", "false")])
        # one row per source and field, and one per field
        for r in sums.collect():
            if r["s"] is None:
                prior = prior | {r["f"]: (r["true"] + weight) / (r["true"] + r["false"] + 2 * weight)}
            else:
                sens, spec = (r["tp"] + weight * start[0]) / (r["true"] + weight), (r["tn"] + weight * start[1]) / (r["false"] + weight)
                q = q | {(r["s"], r["f"]): (min(max(sens, 0.01), 0.99), min(max(spec, 0.01), 0.99))}
    return q, prior


def judged_values(claim: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(cluster_id, field_name, value, document_id, source, n_yes, n_no, posterior, retained) of every claimed value.

    ``value`` is the value itself, a full text's SHA-256; document_id and source name its most trusted holder.
    """
    q, prior = latent_quality(claim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [posterior(f, v, q, prior) for f, v in zip(b["field_name"], b["votes"])]
            count = lambda side: [sum(v[side] for v in vs) for vs in b["votes"]]  # noqa: E731, B023
            yield pd.DataFrame({**{c: b[c] for c in ("cluster_id", "field_name", "value", "document_id", "source")}, "n_yes": count("yes"), "n_no": count("no"), "posterior": p, "retained": [x >= threshold for x in p]})

    slim = claim.select("cluster_id", "field_name", F.col("shown").alias("value"), "holder.document_id", "holder.source", "votes")
    return slim.mapInPandas(run, "cluster_id string, field_name string, value string, document_id string, source string, n_yes int, n_no int, posterior double, retained boolean")


def agreement(claim: DataFrame) -> DataFrame:
    """Per field: groups, those whose members assert several values, and how often the value the model holds for most probable is that of the stated order.

    ``n_same`` counts all groups, ``n_same_contested`` those with several values. Equal posteriors go to the more trusted holder.
    """
    judged = judged_values(claim).join(claim.select("cluster_id", "field_name", F.col("holder.document_id").alias("document_id"), F.col("holder.source").alias("source"), "holder"), ["cluster_id", "field_name", "document_id", "source"])
    best = judged.groupBy("cluster_id", "field_name").agg(F.min("holder").alias("stated"), F.min(F.struct((-F.round("posterior", 9)).alias("p"), "holder")).alias("m"), F.count("*").alias("k"), F.count_if("retained").alias("kept"))
    same = F.col("stated").eqNullSafe(F.col("m.holder"))
    return best.groupBy("field_name").agg(F.count("*").alias("n_groups"), F.count_if(F.col("k") > 1).alias("n_contested"), F.count_if(same).alias("n_same"), F.count_if(same & (F.col("k") > 1)).alias("n_same_contested"), F.sum("k").alias("n_values"), F.sum("kept").alias("n_retained"))
