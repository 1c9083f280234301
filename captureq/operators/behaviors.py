"""Behaviour selection, coverage and deadlines; TLS observations, certificate chains and verification verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captureq.functions.url import host


def host_behaviors(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """page_id, pos, behavior: exact-host entries, then those of the last two labels (once where both are equal).

    registry has host, ord and behavior; it is a configuration table, joined by key."""
    h = host(F.col("url"))
    labels = F.split(h, r"\.")
    short = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    keys = F.array_distinct(F.array(h, short))
    asked = pages.select("page_id", F.posexplode(keys).alias("rank", "host"))
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("rank", "ord"))
    return asked.join(registry, "host").withColumn("pos", pos.cast("long")).select("page_id", "pos", "behavior")


def coverage(reports: DataFrame, viewport_height: int) -> DataFrame:
    """scroll_exhausted, scroll_steps and scrolled_px of the first autoscroll entry; null unless both values are there.

    reports has id and ran array<struct<id, steps long, exhausted boolean>>."""
    entry = F.get(F.filter("ran", lambda r: r["id"] == "autoscroll"), F.lit(0))
    fine = entry["exhausted"].isNotNull() & entry["steps"].isNotNull()
    return reports.select("id", F.when(fine, F.struct(entry["exhausted"].alias("scroll_exhausted"), entry["steps"].alias("scroll_steps"), (entry["steps"] * viewport_height).alias("scrolled_px"))).alias("coverage"))


def deadline_cut(steps: DataFrame, budget_ms: int) -> DataFrame:
    """Steps that start before their run's budget is spent; later ones are skipped."""
    before = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("spent_before", F.coalesce(F.sum("ms").over(before), F.lit(0)).cast("long")).withColumn("ran", F.col("spent_before") < budget_ms)


def tls_hosts(observed: DataFrame) -> DataFrame:
    """First detailed observation of each https host; a host seen only without details has a null."""
    return observed.filter(F.col("url").startswith("https:")).groupBy("host").agg(F.min_by("details", F.when(F.col("details").isNotNull(), F.col("seq"))).alias("details"))


def chain_reaches(certs: DataFrame, anchors: list[str], most: int = 10) -> DataFrame:
    """chain, reaches: whether walking issuer links from position 0 arrives at a trusted subject within the chain.

    certs has chain, pos, subject, issuer; a chain is a handful of certificates."""
    order = F.array_sort(F.collect_list(F.struct("pos", "subject", "issuer")))
    start = F.struct(F.lit(None).cast("string").alias("want"), F.lit(False).alias("ok"), F.lit(False).alias("broken"))

    def step(acc: Column, c: Column) -> Column:
        linked = acc["want"].isNull() | (c["subject"] == acc["want"])
        good = linked & ~acc["broken"]
        return F.struct(F.when(good, c["issuer"]).otherwise(acc["want"]).alias("want"), (acc["ok"] | (good & (c["issuer"].isin(*anchors) | c["subject"].isin(*anchors)))).alias("ok"), (acc["broken"] | ~linked).alias("broken"))

    return certs.filter(F.col("pos") < most).groupBy("chain").agg(F.aggregate(order, start, step)["ok"].alias("reaches"))


def issuers_reach(certs: DataFrame, anchors: list[str], most: int = 10) -> DataFrame:
    """chain, reaches: whether issuer links lead from the chain's leaf (its certificate of least pos) to a trusted subject,
    in at most `most` steps, over the certificates of the chain in whatever order they stand (`chain_reaches` follows the
    given order, and takes a chain that does not hold together for lost).

    certs: chain, pos, subject, issuer. All issuers of a subject are followed, so cross-signed certificates count by
    either; a subject that was reached before adds nothing, so loops end. A null pos comes first, a null issuer leads
    nowhere, rows of a null chain are one chain; a repeated certificate counts once. A chain's distinct certificates meet
    in one row: a handful, as a server sends them."""
    whole = F.array_distinct(F.array_sort(F.collect_set(F.struct("pos", "subject", "issuer"))))
    first = F.array_compact(F.array(F.get("c", F.lit(0))["subject"]))

    def step(reached: Column, _: Column) -> Column:
        issuers = F.transform(F.filter("c", lambda c: F.coalesce(F.array_contains(reached, c["subject"]), F.lit(False))), lambda c: c["issuer"])
        return F.array_union(reached, F.array_compact(issuers))

    reached = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(most), F.size("c"))), first, step)
    trusted = F.array(*[F.lit(a) for a in anchors]).cast("array<string>")
    return certs.groupBy("chain").agg(whole.alias("c")).select("chain", F.arrays_overlap(reached, trusted).alias("reaches"))


#: Seconds of a bucket of the validity lookup.
VALIDITY_BUCKET = 28 * 86_400


def validity_at(signatures: DataFrame, validity: DataFrame, bucket: int = VALIDITY_BUCKET) -> DataFrame:
    """id, state of each signature at the time that it claims: `ok` where some period of its certificate holds that time
    (both ends included), `expired` where periods began before it but all have ended, `not-yet-valid` where none has
    begun, `unknown` where the certificate has no period, `skipped` where the signature claims no time.

    signatures: id, cert, claimed_at; validity: cert, valid_from, valid_to. Any may be null: a null cert has no period, a
    period without a beginning is none, one without an end never ends. Repeated rows count each.

    No interval join: of the periods that have begun, the latest end decides, a running maximum in order of time. It runs
    within buckets of time, and what earlier buckets bring is a running maximum over one row a bucket, so a certificate
    that very many signatures name is as many partitions as it has buckets."""
    never = F.lit("9999-12-31 00:00:00").cast("timestamp")
    begun = validity.filter("cert is not null and valid_from is not null").select("cert", F.col("valid_from").cast("timestamp").alias("t"), F.coalesce(F.col("valid_to").cast("timestamp"), never).alias("end"))
    asked = signatures.filter("cert is not null and claimed_at is not null").select("cert", F.col("claimed_at").cast("timestamp").alias("t"), F.struct("id").alias("asked"))
    slot = F.floor(F.unix_seconds("t") / bucket).alias("slot")
    none = F.lit(None)
    both = begun.select("cert", slot, "t", "end", none.cast(asked.schema["asked"].dataType).alias("asked")).unionByName(asked.select("cert", slot, "t", none.cast("timestamp").alias("end"), "asked"))
    # Of one instant, periods come before the signatures that they hold.
    inside = Window.partitionBy("cert", "slot").orderBy("t", F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("latest", F.max("end").over(inside)).filter(F.col("asked").isNotNull())
    ends = both.groupBy("cert", "slot").agg(F.max("end").alias("top"))
    earlier = ends.withColumn("earlier", F.max("top").over(Window.partitionBy("cert").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))).select("cert", "slot", "earlier")
    has = begun.select("cert").distinct().withColumn("has", F.lit(True))
    told = near.join(earlier, ["cert", "slot"]).join(has, "cert", "left").withColumn("latest", F.greatest("latest", "earlier"))
    state = F.when(F.col("has").isNull(), "unknown").when(F.col("latest").isNull(), "not-yet-valid").when(F.col("latest") >= F.col("t"), "ok").otherwise("expired")
    rest = signatures.filter("cert is null or claimed_at is null").select("id", F.when(F.col("claimed_at").isNull(), "skipped").otherwise("unknown").alias("state"))
    return told.select("asked.id", state.alias("state")).unionByName(rest)


def verdict(checks: DataFrame) -> DataFrame:
    """Tri-state verification of the ordered checks hash, signature, domain, timestamp (true, false, null = skipped) and
    the first that failed."""
    names = ["hash", "signature", "domain", "timestamp"]
    state = {n: F.when(F.col(n).isNull(), "skipped").when(F.col(n), "ok").otherwise("failed") for n in names}
    reason = F.coalesce(*[F.when(~F.col(n), n) for n in names])
    return checks.select("id", *[state[n].alias(n) for n in names], reason.alias("reason"))
