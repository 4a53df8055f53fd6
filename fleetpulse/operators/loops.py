"""Network loops: signals, bursts, periods, motifs, confidence, selection and comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.staging import cut
from fleetpulse.operators.periodic import LAGS, LEAST, POINTS, SIGNIFICANT

#: Least bursts, loops kept, reach of equal periods, least confidence, limits of severity and of a change.
BURSTS, KEPT, CLOSE, CONFIDENCE = 3, 8, 0.30, 0.35
#: The token that a kind of signal always has, and the order of tokens in a motif.
KIND_TOKEN = {"dns": "dns_high", "connect": "connect_high", "retry": "reconnect_high", "websocket": "websocket_reconnect", "failure": "http_failed"}
PRIORITY = [["dns_high"], ["connect_high"], ["reconnect_high", "websocket_reconnect"], ["websocket_failure", "http_5xx", "http_failed"]]
MOTIF_CLASSES = ["dns_high", "connect_high", "reconnect_high", "websocket_reconnect", "websocket_failure", "http_5xx", "http_failed"]
#: Where a route ends in a metric's name, events of web sockets, methods that begin a route.
ROUTE_ENDS = [".dns.lookup.count", ".connect.attempt.count", ".retry_or_reconnect.count", ".failed.count", ".started.count", ".finished.count", ".reused_connection.count", ".phase."]
SOCKET_EVENTS = ["open", "response_code", "reconnect", "message", "close_code", "closing", "closed", "failure", "lifetime_ms"]
METHODS = "^(get|post|put|patch|delete|head|options)_"

SIGNAL = "signal:string, kind:string, route:string, owner:string, value:double, tokens:array<string>"


def network_metric(name: Column) -> Column:
    """Kind, route, owner and tokens that a network metric's name tells; kind is null for other metrics."""
    low = F.lower(name)
    rest = F.regexp_replace(low, "^network[.]route[.]", "")
    ends = [F.when(F.instr(rest, e) > 0, F.substring_index(rest, e, 1)) for e in ROUTE_ENDS]
    route = F.when(low.startswith("network.route."), F.coalesce(*ends, F.substring_index(rest, ".", 1))).otherwise("")
    parts = F.split(F.regexp_replace(low, "^websocket[.]", ""), "[.]")
    prefix = F.when((F.size(parts) < 2) | F.get(parts, F.lit(0)).isin(*SOCKET_EVENTS), "").otherwise(F.get(parts, F.lit(0)))
    socket, is_route = low.startswith("websocket."), prefix.rlike(METHODS)
    has = lambda *xs: F.when(sum((F.instr(low, x) for x in xs), F.lit(0)) > 0, True).otherwise(False)

    def of(kind: str, *tokens: str, route: Column = route, owner: Column = F.lit("")) -> Column:
        return F.struct(F.lit(kind).alias("kind"), route.alias("route"), owner.alias("owner"), F.array(*map(F.lit, tokens)).alias("tokens"))

    of_socket = {"route": F.when(is_route, prefix).otherwise(""), "owner": F.when(is_route, "").otherwise(prefix)}
    starts = F.struct(F.lit("route").alias("kind"), route.alias("route"), F.lit("").alias("owner"), F.array(F.concat(F.lit("route:"), route)).alias("tokens"))
    return (F.when(socket & has("reconnect.count"), of("websocket", "websocket_reconnect", "reconnect_high", **of_socket)).when(socket & has("failure"), of("websocket", "websocket_failure", "http_failed", **of_socket))
            .when(socket | ~low.startswith("network."), None).when(has("retry_or_reconnect"), of("retry", "reconnect_high")).when(has("dns.lookup", "dns_attempts"), of("dns", "dns_high"))
            .when(has("connect.attempt", "connect_attempts", "phase.connect.failure"), of("connect", "connect_high"))
            .when(has("failed.count", "failure.count", ".failure.") & has("5xx"), of("failure", "http_failed", "http_5xx")).when(has("failed.count", "failure.count", ".failure."), of("failure", "http_failed"))
            .when((route != "") & has(".started.count", ".finished.count"), starts))


def contributions(http: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """What each call (run_set, ord, bucket, route, owner, dns_ms, connect_ms, failed, server_error) and network
    metric (run_set, ord, bucket, name, gauge, value) adds to which signal, with its tokens."""
    route, owner = F.concat(F.lit("route:"), "route"), F.concat(F.lit("owner:"), "owner")
    base = F.array(route, owner)

    def of(signal: Column, kind: str, *tokens: Column) -> Column:
        return F.struct(signal.alias("signal"), F.lit(kind).alias("kind"), F.col("route").alias("route"), F.col("owner").alias("owner"), F.lit(1.0).alias("value"),
                        (F.concat(F.array_compact(F.array(*tokens)), base) if tokens else base).alias("tokens"))

    def both(when: Column, kind: str, *tokens: Column) -> list[Column]:
        return [F.when(when, of(F.lit(f"{kind}:global"), kind, *tokens)), F.when(when, of(F.concat(F.lit(f"{kind}:"), route), kind, *tokens))]

    bad = F.col("failed") | F.col("server_error")
    rows = [of(route, "route"), of(owner, "owner"), *both(F.col("dns_ms") > 0, "dns", F.lit("dns_high")), *both(F.col("connect_ms") > 0, "connect", F.lit("connect_high")),
            *both(bad, "failure", F.lit("http_failed"), F.when(F.col("server_error"), "http_5xx"))]
    out = http.select("run_set", "ord", "bucket", F.inline(F.array_compact(F.array(*rows))))
    if metrics is None:
        return out
    m = metrics.withColumn("m", network_metric(F.col("name"))).filter("m is not null and value > 0")
    m = m.filter(~(F.col("gauge") & F.contains(F.lower("name"), F.lit("attempts")) & (F.col("value") <= 1)))
    some = lambda c: F.when(F.col(f"m.{c}") != "", F.concat(F.lit(f"{c}:"), f"m.{c}"))
    return out.unionByName(m.select("run_set", "ord", "bucket", F.concat_ws(":", F.lit("metric"), "m.kind", "m.route", "m.owner", "name").alias("signal"), "m.kind", "m.route", "m.owner",
                                    F.col("value").cast("double").alias("value"), F.concat("m.tokens", F.array_compact(F.array(some("route"), some("owner")))).alias("tokens")))


def points(rows: DataFrame) -> DataFrame:
    """Values above 0 by signal and bucket; ``n`` buckets of the run set, all others of which are 0."""
    span = rows.groupBy("run_set").agg((F.max("bucket") + 1).alias("n"))
    return rows.groupBy("run_set", "signal", "bucket").agg(F.sum("value").alias("value")).join(F.broadcast(span), "run_set")


def described(rows: DataFrame) -> DataFrame:
    """Kind, and first known route and owner of each signal."""
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("ord"))), F.lit("")).alias(c)
    return rows.groupBy("run_set", "signal").agg(F.min("kind").alias("kind"), first("route"), first("owner"))


def bursts(p: DataFrame) -> DataFrame:
    """Points at or over max(1, median + 3 MAD, 2 median), and over the median of the positive ones (if that is over
    1) where the median is 0.  Empty buckets enter the medians by their number, not as rows."""
    key = ["run_set", "signal"]
    zeros = p.groupBy(*key, "n").agg((F.col("n") - F.count(F.lit(1))).alias("times")).withColumn("value", F.lit(0.0))
    every = p.select(*key, "value", F.lit(1).cast("bigint").alias("times")).unionByName(zeros.filter("times > 0").select(*key, "value", "times"))
    med = every.groupBy(*key).agg(F.expr("percentile(value, 0.5, times)").alias("median"), F.expr("percentile(value, 0.5) FILTER (WHERE value > 0)").alias("positive"))
    mad = every.join(F.broadcast(med), key).groupBy(*key, "median", "positive").agg(F.expr("percentile(abs(value - median), 0.5, times)").alias("mad"))
    own = F.when((F.col("median") == 0) & (F.col("positive") > 1), F.col("positive")).otherwise(0.0)
    limit = F.greatest(F.lit(1.0), F.col("median") + 3 * F.col("mad"), 2 * F.col("median"), own)
    return p.join(F.broadcast(mad.select(*key, limit.alias("limit"))), key).filter(F.col("value") >= F.col("limit")).select(*key, "bucket", "value")


PERIODIC = "run_set string, signal string, first_lag double, lags array<double>, correlations array<double>, peak double, peak_confidence double"


def periodic(p: DataFrame) -> DataFrame:
    """D01-D05 of each signal, from its points above 0: in buckets, the first significant lag, the three best lags, and
    the strongest spectral peak.  A signal has at most as many points as its run set has buckets (a bound of the
    timeline), is thinned evenly to POINTS, and is transformed by FFT, which no built-in function offers."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(int(pdf["n"].iloc[0]))
        x[pdf["bucket"].to_numpy()] = pdf["value"].to_numpy()
        if len(x) > POINTS:
            x = x[np.floor(np.arange(POINTS) * ((len(x) - 1) / (POINTS - 1)) + 0.5).astype(int)]
        n, c = len(x), x - x.mean()
        total = float(c @ c)
        r = np.array([c[:-k] @ c[k:] / total for k in range(1, min(LAGS, n // 2) + 1)]) if total > 0 else np.zeros(0)
        strong = np.flatnonzero(r >= SIGNIFICANT)
        best = [k for k in np.argsort(-r, kind="stable") if r[k] > 0][:3]
        power = np.abs(np.fft.rfft(c * 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / max(1, n - 1)))))[1:n // 2 + 1] ** 2
        peak, confidence = None, 0.0
        if len(power) and power.max() > 0:
            back = np.median(power) or power.mean() or 1.0
            share = power[power > 0] / power.sum()
            entropy = float(-(share * np.log2(share)).sum() / np.log2(len(power))) if len(power) > 1 else 1.0
            trust = 0.65 * np.clip((power / back - 2) / 8, 0, 1) + 0.35 * min(1.0, max(0.0, 1 - entropy))
            k = max(range(len(power)), key=lambda i: (round(trust[i], 12), power[i]))
            peak, confidence = n / (k + 1), float(trust[k])
        return pd.DataFrame([(pdf["run_set"].iloc[0], pdf["signal"].iloc[0], float(strong[0] + 1) if len(strong) else None, [float(k + 1) for k in best], [float(r[k]) for k in best], peak, confidence)],
                            columns=[c.split()[0] for c in PERIODIC.split(", ")])

    return p.filter(F.col("n") >= LEAST).groupBy("run_set", "signal").applyInPandas(one, PERIODIC)


def close(a: Column, b: Column) -> Column:
    return (a > 0) & (b > 0) & (F.abs(a - b) / F.greatest(a, b) <= CLOSE)


def priority(token: Column) -> Column:
    out = F.when(F.startswith(token, F.lit("route:")), 4).when(F.startswith(token, F.lit("owner:")), 5).otherwise(6)
    for i, names in enumerate(PRIORITY):
        out = F.when(token.isin(*names), i).otherwise(out)
    return out


def motifs(rows: DataFrame, found: DataFrame, about: DataFrame) -> DataFrame:
    """Up to five tokens that repeat over a signal's bursts, and the share of three that do."""
    key = ["run_set", "signal"]
    at = rows.select(*key, "bucket", F.explode("tokens").alias("token")).groupBy(*key, "bucket", "token").agg(F.count(F.lit(1)).alias("total"))
    own = at.join(found.select(*key, "bucket"), [*key, "bucket"]).groupBy(*key, "token").agg(F.count(F.lit(1)).alias("buckets"), F.sum("total").alias("total")).withColumn("seen", F.lit(True))
    kind = F.lit(None).cast("string")
    for k, t in KIND_TOKEN.items():
        kind = F.when(F.col("kind") == k, F.lit(t)).otherwise(kind)
    n = found.groupBy(*key).agg(F.count(F.lit(1)).alias("buckets"))
    always = about.select(*key, kind.alias("token")).filter("token is not null").join(n, key).join(own, [*key, "token"], "left_anti")
    every = own.unionByName(always.select(*key, "token", "buckets", F.col("buckets").alias("total"), F.lit(False).alias("seen")))
    every = every.filter((F.col("buckets") >= 2) | F.startswith("token", F.lit("route:")) | F.startswith("token", F.lit("owner:"))).withColumn("order", priority(F.col("token")))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("order", F.desc("buckets"), F.desc("total"), "token"))).filter("rank <= 5")
    out = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("m"), F.count_if(F.col("seen") & (F.col("buckets") >= 2)).alias("repeated"))
    return out.select(*key, F.transform("m", lambda x: x["token"]).alias("motif"), F.least(F.lit(1.0), F.col("repeated") / 3).alias("motif_score"))


def gaps(found: DataFrame) -> DataFrame:
    """Distance of each burst to the one before it; null at the first."""
    w = Window.partitionBy("run_set", "signal").orderBy("bucket")
    return found.withColumn("gap", F.col("bucket") - F.lag("bucket").over(w))


def loops(rows: DataFrame, size: DataFrame) -> DataFrame:
    """N02-N07, N10 of contributions; ``size`` has run_set and its bucket's ms.  One row per signal that is a loop."""
    key = ["run_set", "signal"]
    p, about = cut(points(rows), "points"), cut(described(rows), "signals")
    found = cut(gaps(bursts(p)), "bursts")
    sums = found.groupBy(*key).agg(F.count(F.lit(1)).alias("bursts"), F.median("gap").alias("gap"), F.sum("value").alias("burst_sum"), F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    j = sums.filter(F.col("bursts") >= BURSTS).join(cut(periodic(p), "periodic"), key).join(about, key).join(F.broadcast(size), "run_set")
    ms = lambda c: F.round(F.col(c)).cast("bigint") * F.col("size")
    j = j.withColumns({"burst_ms": ms("gap"), "lag_ms": F.coalesce(ms("first_lag"), F.lit(0)), "peak_ms": F.coalesce(F.round(F.col("peak") * F.col("size")).cast("bigint"), F.lit(0))})
    lag, peak, own = F.col("lag_ms"), F.col("peak_ms"), F.col("burst_ms")
    period = F.when(close(lag, own), lag).when((lag > 0) & (own == 0), lag).when((peak > 0) & ((own == 0) | close(peak, own) | (F.col("peak_confidence") >= 0.45)), peak).otherwise(own)
    j = j.withColumn("period_ms", period).filter("period_ms > 0")
    expected = F.round(F.col("period_ms") / F.col("size"))
    near = found.filter("gap is not null").join(j.select(*key, expected.alias("expected")), key).groupBy(*key).agg(F.avg(F.when((F.abs(F.col("gap") - F.col("expected")) <= 1) & (F.col("expected") > 0), 1.0).otherwise(0.0)).alias("regularity"))
    j = j.join(near, key).filter(~((F.col("regularity") < 0.45) & (F.col("peak_confidence") < 0.25) & (lag == 0))).join(motifs(rows, found, about), key, "left")
    matching = F.filter(F.arrays_zip("lags", "correlations"), lambda x: close(x["lags"] * F.col("size"), F.col("period_ms")))
    auto = F.when(close(lag, F.col("period_ms")), 1.0).otherwise(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.array_max(F.transform(matching, lambda x: x["correlations"])))), F.lit(0.0)))
    confidence = 0.20 * F.least(F.lit(1.0), F.col("bursts") / 6) + 0.30 * F.col("regularity") + 0.25 * auto + 0.15 * F.col("peak_confidence") + 0.10 * F.coalesce("motif_score", F.lit(0.0))
    j = j.withColumn("confidence", confidence).filter(F.col("confidence") >= CONFIDENCE)
    return named(j)


def named(j: DataFrame) -> DataFrame:
    """Burn, severity, parties filled from the motif, key and explanation path."""
    motif = F.coalesce("motif", F.array().cast("array<string>"))
    told = lambda c: F.coalesce(F.regexp_replace(F.get(F.filter(motif, lambda t: F.startswith(t, F.lit(f"{c}:"))), F.lit(0)), f"^{c}:", ""), F.lit(""))
    j = j.withColumns({c: F.when(F.col(c) != "", F.col(c)).otherwise(told(c)) for c in ("route", "owner")})
    burn, c = F.col("burst_sum") * (1 + F.col("confidence")), F.col("confidence")
    kind = F.coalesce(F.get(F.filter(motif, lambda t: t.isin(*MOTIF_CLASSES)), F.lit(0)), F.get(motif, F.lit(0)), F.lit("unknown"))
    some = lambda c: F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), c))
    path = F.array_distinct(F.concat(F.array_compact(F.array(F.lit("symptom:network_loop"), some("owner"), some("route"), F.concat(F.lit("phase:"), "kind"))), motif))
    j = j.withColumns({"burn": burn, "motif_class": kind, "path": path})
    severity = F.when((c >= 0.70) & (F.col("burn") >= 8), "high").when((c >= 0.45) | (F.col("burn") >= 4), "medium").otherwise("ok")
    return j.select("run_set", "signal", "kind", "route", "owner", "period_ms", "confidence", F.array_join(motif, "|").alias("motif"), (F.col("first") * F.col("size")).alias("first_ms"),
                    (F.col("last") * F.col("size")).alias("last_ms"), "burn", severity.alias("severity"), F.concat_ws("|", "route", "owner", "motif_class").alias("key"), F.array_join("path", " > ").alias("path"))


def selected(found: DataFrame) -> DataFrame:
    """Of each key the first in order, then KEPT of each run set: by severity, confidence, known parties, burn."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    known = F.when(F.col("route") != "", 1).otherwise(0) + F.when(F.col("owner") != "", 1).otherwise(0)
    order = [rank.desc(), F.desc("confidence"), known.desc(), F.desc("burn"), F.col("key"), F.col("signal")]
    one = found.withColumn("_r", F.row_number().over(Window.partitionBy("run_set", "key").orderBy(*order))).filter("_r = 1")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("run_set").orderBy(*order))).filter(F.col("_r") <= KEPT).drop("_r")


def compare(found: DataFrame) -> DataFrame:
    """Loops of baseline and candidate by key: appeared, disappeared, strengthened, weakened, changed."""
    side = lambda s, v, a: F.max(F.when(F.col("run_set") == s, F.col(v))).alias(a)
    j = found.groupBy("key").agg(*[side(s, v, f"{p}_{v}") for p, s in (("b", "baseline"), ("c", "candidate")) for v in ("period_ms", "confidence", "burn", "severity")])
    no_b, no_c = F.col("b_burn").isNull(), F.col("c_burn").isNull()
    burn = F.coalesce("c_burn", F.lit(0.0)) - F.coalesce("b_burn", F.lit(0.0))
    trust = F.coalesce("c_confidence", F.lit(0.0)) - F.coalesce("b_confidence", F.lit(0.0))
    pct = F.when(F.col("b_burn") != 0, burn * 100 / F.col("b_burn")).otherwise(0.0)
    moved = ~close(F.col("b_period_ms"), F.col("c_period_ms")) | (F.abs(burn) >= 3) | (F.abs(pct) >= 35) | (F.abs(trust) >= 0.15)
    weaker, stronger = (burn < -3) & (trust <= 0), (burn > 0) | (trust > 0.15)
    status = F.when(no_b, "appeared").when(no_c, "disappeared").when(weaker, "weakened").when(stronger, "strengthened").otherwise("changed")
    severity = F.when(no_b, F.col("c_severity")).when(no_c | weaker, "ok").when(stronger & (F.col("c_severity") != "ok"), F.col("c_severity")).otherwise("medium")
    return j.filter(no_b | no_c | moved).select("key", status.alias("status"), F.coalesce("b_period_ms", F.lit(0)).alias("b_period_ms"), F.coalesce("c_period_ms", F.lit(0)).alias("c_period_ms"),
                                                 F.round(burn, 6).alias("burn_delta"), F.round(trust, 6).alias("confidence_delta"), severity.alias("severity"))
