"""Proportional-hazards fits, per-instrument hazards, partial likelihood and concordance.

Rows are dealt once, by ranges of (stratum, time), and kept packed in that order. A Newton step reads them twice, without moving them:
first every partition tells the sums of its first and last stratum, from which the risk sets that reach over partition edges follow, then
it adds up score and information. All models of a call, such as one per instrument, share the passes. A stratum or a tied time may
span any number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.operators import ordered as od
from sitefold.operators.moments import complete
from sitefold.runtime import cut

TIES = ("efron", "breslow")
# Terms of an Efron tie that are added one by one.
EXPLICIT_TERMS = 16
PACK_BYTES = 16 << 20    # rows packed together
MODELS = 64              # models, one per instrument say, that share a pass


def tie_sums(d: np.ndarray, s0: np.ndarray, e0: np.ndarray, ties: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the d events of each tie of 1/q, 1/q^2 and ln q, q the risk total each event sees.

    Breslow: all see s0. Efron: q_l = s0 - (l/d) e0, an arithmetic progression, so the sums are
    differences of digamma, trigamma and log-gamma values. The last few terms (where the
    progression may come close to zero) are added one by one and the rest by asymptotic series
    around the half-integer points, so a tie of any size is one cell.
    """
    d = d.astype(np.float64)
    if ties == "breslow":
        return d / s0, d / (s0 * s0), d * np.log(s0)
    h = e0 / d
    a = s0 / h
    n = np.maximum(d - EXPLICIT_TERMS, 0.0)
    one, two, logs = np.zeros(len(d)), np.zeros(len(d)), np.zeros(len(d))
    for k in range(EXPLICIT_TERMS):
        j = n + k
        q = np.where(j < d, a - j, 1.0)
        one += np.where(j < d, 1.0 / q, 0.0)
        two += np.where(j < d, 1.0 / (q * q), 0.0)
        logs += np.log(q)
    top, low = a + 0.5, a - n + 0.5
    ratio = -np.log1p(-n / top)

    def series(x, *coefs):
        """sum of c x^-p"""
        return sum(c * x ** -float(power) for power, c in coefs)

    digamma = ((2, 1 / 24), (4, -7 / 960), (6, 31 / 8064), (8, -127 / 30720))
    trigamma = ((3, -1 / 12), (5, 7 / 240), (7, -31 / 1344), (9, 127 / 3840))
    loggamma = ((1, -1 / 24), (3, 7 / 2880), (5, -31 / 40320))
    one += ratio + series(top, *digamma) - series(low, *digamma)
    two += n / (top * low) + series(low, *trigamma) - series(top, *trigamma)
    logs += n * np.log(top) + low * ratio - n + series(top, *loggamma) - series(low, *loggamma)
    return one / h, two / (h * h), logs + d * np.log(h)


class Model:
    """A regression on some of the packed columns: what its sums are and what follows from them.

    A cell of rows has 1 + p + p(p+1)/2 risk sums (of e, x e and x x' e), and for its events d, the sum of the linear predictor, that of x, and the
    same sums again."""

    def __init__(self, cols: Sequence[int]):
        self.cols, self.p = list(cols), len(cols)
        self.upper = [(i, j) for i in range(self.p) for j in range(i, self.p)]
        self.risk = 1 + self.p + len(self.upper)
        self.size = self.risk + 2 + self.p + self.risk
        self.terms = 2 + self.p + len(self.upper)

    def cells(self, x: np.ndarray, event: np.ndarray, beta: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(cells, size): sums over the rows from each start; beta has one row for all or one per row. Rows without a value count nowhere."""
        x = x[:, self.cols]
        there = ~np.isnan(x).any(1)
        x = np.where(there[:, None], x, 0.0)
        eta = (x * beta).sum(1)
        e = np.where(there, np.exp(eta), 0.0)
        d = event * there
        powers = np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i, j in self.upper)]) * e[:, None]
        return np.add.reduceat(np.column_stack([powers, d, d * eta, d[:, None] * x, powers * d[:, None]]), starts, axis=0)

    def score(self, at_risk: np.ndarray, cells: np.ndarray, ties: str) -> np.ndarray:
        """(cells, terms) of cells with events: log likelihood, score, information (upper triangle) and the uncentred information of the first column."""
        p, r = self.p, at_risk
        d, deta, dx, e = cells[:, self.risk], cells[:, self.risk + 1], cells[:, self.risk + 2:self.risk + 2 + p], cells[:, self.risk + 2 + p:]
        i1, i2, logs = tie_sums(d, r[:, 0], e[:, 0], ties)
        # (s - f e) / q = c / q + k, with f eliminated through q
        k = e[:, 1:] / e[:, :1] if ties == "efron" else np.zeros_like(e[:, 1:])
        c = r[:, 1:] - k * r[:, :1]
        out = [deta - logs, *(dx[:, i] - (c[:, i] * i1 + d * k[:, i]) for i in range(p))]
        for at, (i, j) in enumerate(self.upper, p):
            out.append(c[:, at] * i1 + d * k[:, at] - (c[:, i] * c[:, j] * i2 + (c[:, i] * k[:, j] + c[:, j] * k[:, i]) * i1 + d * k[:, i] * k[:, j]))
        return np.column_stack([*out, c[:, p] * i1 + d * k[:, p]])


def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column("_key").combine_chunks().dictionary_encode()
        codes = key.indices.to_numpy().astype(np.int32)  # in order of appearance, and rows are sorted by key
        x = t.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.RecordBatch.from_arrays([pa.array([key.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([np.bincount(codes)], pa.list_(pa.int64())), pa.array([t.column("_time").to_numpy().tobytes()], pa.binary()),
                                           pa.array([t.column("_event").to_numpy().astype(np.int8).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["keys", "runs", "time", "event", "x"])

    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) * 8 * (width + 2) >= PACK_BYTES:
            yield packed()
            held = []
    if any(h.num_rows for h in held):
        yield packed()


def _dealt(df: DataFrame, x: Column, width: int, strata: Sequence[str], time: str, event: str) -> DataFrame:
    """Rows in the order of (stratum, falling time), packed and written: the partitions of the result are ranges of that order. Equal
    times are spread by a hash of the whole row, so that a tie may fill several partitions."""
    key = F.to_json(F.struct(*strata)) if strata else F.lit("")
    rows = complete(df, [time, event]).select(key.alias("_key"), F.col(time).cast("double").alias("_time"), F.col(event).cast("int").alias("_event"), x.alias("_x"), F.xxhash64(*df.columns).alias("_spread"))
    rows = rows.repartitionByRange(od.bucket_count(df), "_key", F.col("_time").desc(), "_spread").sortWithinPartitions("_key", F.col("_time").desc())
    return cut(rows.select("_key", "_time", "_event", "_x").mapInArrow(lambda b: _pack(b, width), "keys array<string>, runs array<bigint>, time binary, event binary, x binary"))


def _beta_of(betas: dict, keys: list[str], codes: np.ndarray, model: Model, at: int) -> np.ndarray:
    own = slice(at, at + model.p)
    return betas[None][None, own] if None in betas else np.array([betas[k][own] for k in keys])[codes]


class _Scan:
    """Sums of a partition's rows, taken in order. What the cells of its first and last (stratum, time) hold is left to the driver, as they may go on
    in the neighbouring partitions."""

    def __init__(self, models: list[Model], betas: dict, ties: str, offset: np.ndarray | None):
        self.models, self.betas, self.ties, self.offset = models, betas, ties, offset
        self.edges = np.cumsum([0] + [m.size for m in models])
        self.places = np.cumsum([0] + [m.p for m in models])
        self.is_risk = np.concatenate([np.arange(m.size) < m.risk for m in models])
        self.first = self.last = None        # (key, time, sums) of the first and the last cell
        self.inside: dict[str, np.ndarray] = {}  # sums of the closed cells of a stratum, without the first
        self.terms: dict[str | None, np.ndarray] = {}

    def add(self, keys: list[str], runs: np.ndarray, time: np.ndarray, event: np.ndarray, x: np.ndarray) -> None:
        codes = np.repeat(np.arange(len(runs)), runs)
        starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (time[1:] != time[:-1])]))
        sums = np.concatenate([m.cells(x, event, _beta_of(self.betas, keys, codes, m, at), starts) for m, at in zip(self.models, self.places)], axis=1)
        key, t = [keys[c] for c in codes[starts]], time[starts]
        if self.last is not None:
            k0, t0, s0 = self.last
            if (k0, t0) == (key[0], t[0]):
                sums[0] += s0
            else:
                key, t, sums = [k0, *key], np.concatenate([[t0], t]), np.concatenate([s0[None], sums])
        self.last = (key[-1], t[-1], sums[-1])
        self._close(key[:-1], t[:-1], sums[:-1])

    def _close(self, key: list[str], t: np.ndarray, sums: np.ndarray) -> None:
        if len(key) and self.first is None:
            self.first = (key[0], t[0], sums[0])
            self.inside[key[0]] = np.zeros(sums.shape[1])
            key, t, sums = key[1:], t[1:], sums[1:]
        if not len(key):
            return
        begin = np.flatnonzero([True, *(a != b for a, b in zip(key[1:], key[:-1]))])
        for a, z in zip(begin, [*begin[1:], len(key)]):
            k = key[a]
            before = self.inside.get(k, 0.0)
            if k == self.first[0]:
                before = before + self.first[2] + (0.0 if self.offset is None else self.offset)
            run = np.cumsum(sums[a:z], axis=0)
            if self.offset is not None:
                self._score(k, run + before, sums[a:z])
            self.inside[k] = self.inside.get(k, 0.0) + run[-1]
        for k in [k for k in self.inside if k not in (self.first[0], key[-1])]:
            del self.inside[k]  # strata that are done

    def _score(self, key: str, at_risk: np.ndarray, sums: np.ndarray) -> None:
        out = []
        for m, at in zip(self.models, self.edges):
            some = sums[:, at + m.risk] > 0
            out.append(m.score(at_risk[some, at:at + m.risk], sums[some, at:at + m.size], self.ties).sum(0) if some.any() else np.zeros(m.terms))
        to = None if None in self.betas else key
        self.terms[to] = self.terms.get(to, 0.0) + np.concatenate(out)


def _scanned(models: list[Model], betas: dict, ties: str, offsets: dict[int, np.ndarray] | None):
    """Partition sums without `offsets`, scores with those."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        scan = _Scan(models, betas, ties, None if offsets is None else offsets.get(part, np.zeros(sum(m.size for m in models))))
        for b in batches:
            for r in b.to_pylist():
                time = np.frombuffer(r["time"], np.float64)
                scan.add(r["keys"], np.array(r["runs"]), time, np.frombuffer(r["event"], np.int8).astype(np.float64), np.frombuffer(r["x"], np.float64).reshape(len(time), -1))
        if scan.last is None:
            return
        if offsets is not None:
            rows = [(part, k, None, None, v) for k, v in scan.terms.items()]
        else:
            key, t, sums = scan.last
            rows = [(part, *scan.first[:2], "edge", scan.first[2]), (part, scan.first[0], None, "inside", scan.inside[scan.first[0]])] if scan.first else []
            if scan.first and key != scan.first[0]:
                rows.append((part, key, None, "inside", scan.inside.get(key, np.zeros(len(sums)))))
            rows.append((part, key, t, "edge", sums))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.string()),
                                          pa.array([r[4] for r in rows], pa.list_(pa.float64()))], names=["part", "key", "time", "kind", "sums"])

    return run, "part int, key string, time double, kind string, sums array<double>"


def _evaluated(rows: DataFrame, models: list[Model], betas: dict, ties: str) -> dict:
    """The terms of all models, for every key of `betas`. The driver sees four rows of sums per partition, and one of terms per stratum where
    those have their own coefficients."""
    scan = _Scan(models, betas, ties, np.zeros(0))
    before: dict[str, np.ndarray] = {}
    offsets: dict[int, np.ndarray] = {}
    tied: dict[tuple[str, float], list[np.ndarray]] = {}
    for r in rows.mapInArrow(*_scanned(models, betas, ties, None)).collect():  # in the order of partitions
        sums, so_far = np.array(r["sums"]), before.get(r["key"], 0.0)
        offsets.setdefault(r["part"], np.zeros(len(sums)) + so_far)
        if r["kind"] == "edge":
            tie = tied.setdefault((r["key"], r["time"]), [np.zeros(len(sums)) + so_far, np.zeros(len(sums))])
            tie[1] = tie[1] + sums
        before[r["key"]] = so_far + sums
    for (key, _), (earlier, own) in tied.items():
        scan._score(key, (earlier + own)[None], own[None])
    for r in rows.mapInArrow(*_scanned(models, betas, ties, offsets)).collect():
        scan.terms[r["key"]] = scan.terms.get(r["key"], 0.0) + np.array(r["sums"])
    return scan.terms


def _split_terms(models: list[Model], terms: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
    out, at = [], 0
    for m in models:
        t, info = terms[at:at + m.terms], np.empty((m.p, m.p))
        for (i, j), v in zip(m.upper, t[1 + m.p:]):
            info[i, j] = info[j, i] = v
        out.append((t[0], t[1:1 + m.p], info, t[-1]))
        at += m.terms
    return out


def fit_models(df: DataFrame, models: Sequence[Sequence[str]], strata: Sequence[str] = (), time: str = "time", event: str = "event",
               ties: str = "efron", max_iter: int = 25, tol: float = 1e-9) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Coefficients, covariance and log likelihood of several regressions on the same rows, all fitted in the same passes."""
    if ties not in TIES:
        raise ValueError(f"ties must be one of {TIES}, got {ties!r}")
    cols = sorted({c for m in models for c in m})
    rows = _dealt(complete(df, cols), F.array(*[F.col(c).cast("double") for c in cols]), len(cols), strata, time, event)
    kinds = [Model([cols.index(c) for c in m]) for m in models]

    def values(which: list[int], betas: list[np.ndarray]):
        some = [kinds[i] for i in which]
        terms = _evaluated(rows, some, {None: np.concatenate(betas)}, ties).get(None, np.zeros(sum(m.terms for m in some)))
        return dict(zip(which, _split_terms(some, terms)))

    beta = [np.zeros(m.p) for m in kinds]
    now = values(list(range(len(kinds))), beta)
    left, steps, halved = list(now), {}, {}
    for i in left:
        steps[i], halved[i] = np.linalg.solve(now[i][2], now[i][1]), 0
    taken = dict.fromkeys(left, 0)
    while left:
        tried = values(left, [beta[i] + steps[i] for i in left])
        for i in list(left):
            if not (np.isfinite(tried[i][0]) and tried[i][0] >= now[i][0] - 1e-9 * abs(now[i][0])):
                steps[i], halved[i] = steps[i] / 2, halved[i] + 1
                if halved[i] == 30:
                    raise ArithmeticError("the partial likelihood cannot be raised along the Newton direction")
                continue
            beta[i], now[i], last = beta[i] + steps[i], tried[i], np.max(np.abs(steps[i]))
            taken[i] += 1
            if last < tol:
                left.remove(i)
            elif taken[i] == max_iter:
                raise ArithmeticError(f"no convergence in {max_iter} steps; the last changed a coefficient by {last:.3g}")
            else:
                steps[i], halved[i] = np.linalg.solve(now[i][2], now[i][1]), 0
    return [(beta[i], np.linalg.inv(now[i][2]), float(now[i][0])) for i in range(len(kinds))]


def cox(df: DataFrame, cols: Sequence[str], strata: Sequence[str] = (), time: str = "time", event: str = "event",
        ties: str = "efron", max_iter: int = 25, tol: float = 1e-9) -> DataFrame:
    """Proportional-hazards regression over complete rows, optionally stratified. One row per column: beta, se."""
    beta, cov, ll = fit_models(df, [cols], strata, time, event, ties, max_iter, tol)[0]
    return df.sparkSession.createDataFrame(
        [(c, float(beta[i]), float(np.sqrt(cov[i, i])), ll) for i, c in enumerate(cols)],
        "term string, beta double, se double, log_likelihood double")


def cox_gwas(df: DataFrame, snps: Sequence[str] | int, by: Sequence[str] = ("site",), time: str = "time", event: str = "event",
             ties: str = "efron", max_iter: int = 25, tol: float = 1e-9, g: str = "g") -> DataFrame:
    """Log hazard per unit of dosage, counted or imputed, for every (group, instrument), all fitted in the same passes.

    `snps` names columns, or is the width of the array column `g`. Rows without a dosage do not count for that instrument. Rows are never
    multiplied by instruments: a row keeps its dosages side by side, and a partition one vector of risk sums for all. MODELS instruments share a
    pass. An instrument without variation among those at risk says nothing: its slope is null.
    """
    if ties not in TIES:
        raise ValueError(f"ties must be one of {TIES}, got {ties!r}")
    by = list(by)
    names = [f"snp{j}" for j in range(snps)] if isinstance(snps, int) else list(snps)
    dosages = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda j: F.get(g, j).cast("double")) if isinstance(snps, int) else F.array(*[F.col(s).cast("double") for s in names])
    rows = _dealt(df, dosages, len(names), by, time, event)
    keys = [r["key"] for r in rows.select(F.explode("keys").alias("key")).distinct().collect()]  # as many as the result has groups
    found = []
    for at in range(0, len(names), MODELS):
        models = [Model([j]) for j in range(at, min(at + MODELS, len(names)))]
        beta, se, done, said = (np.zeros((len(keys), len(models))) for _ in range(4))
        for _ in range(max_iter):
            terms = _evaluated(rows, models, dict(zip(keys, beta)), ties)
            for i, k in enumerate(keys):
                for j, (_, u, v, raw) in enumerate(_split_terms(models, terms[k]) if k in terms else []):
                    if v[0, 0] > 1e-12 * raw:
                        step = float(np.clip(u[0] / v[0, 0], -2.0, 2.0))
                        beta[i, j], se[i, j], done[i, j], said[i, j] = beta[i, j] + step, 1 / np.sqrt(v[0, 0]), abs(step) < tol, 1
            if not (said > done).any():
                break
        found += [(k, names[at + j], *((float(beta[i, j]), float(se[i, j])) if said[i, j] else (None, None)), bool(done[i, j] >= said[i, j])) for i, k in enumerate(keys) for j in range(len(models))]
    out = df.sparkSession.createDataFrame(found, "_key string, snp string, beta double, se double, converged boolean")
    groups = df.groupBy(*by).agg(F.lit(1).alias("_one")).select(*by, F.to_json(F.struct(*by)).alias("_key"))
    return groups.join(out, "_key").select(*by, "snp", "beta", "se", "converged")


def partial_likelihood(df: DataFrame, log_hazard: str, strata: Sequence[str] = (), time: str = "time",
                       event: str = "event") -> DataFrame:
    """Negative log partial likelihood per event, Breslow ties (a tie sees its whole tie); 0 with
    no events."""
    keys = list(strata) or ["_all"]
    src = df if strata else df.withColumn("_all", F.lit(0))
    per_time = _summed(complete(src, [log_hazard, time, event]), keys, log_hazard, time, event)
    risk = od.running_log_sums(od.with_buckets(per_time, keys, "time"), keys, "time", "log", descending=True).where("d > 0")
    # both an event's hazard and the hazards at risk may be large or tiny; their difference is what counts
    out = risk.agg(F.sum(F.col("dh") + F.col("d") * (F.col("top") - F.col("cum_log"))).alias("ll"), F.sum("d").alias("events"))
    return out.select(F.when(F.col("events") > 0, -F.col("ll") / F.col("events")).otherwise(0.0).alias("loss"), F.coalesce("events", F.lit(0)).cast("bigint").alias("events"))


def _summed(src: DataFrame, keys: Sequence[str], log_hazard: str, time: str, event: str) -> DataFrame:
    """(keys, time, top, log, d, dh): the largest log hazard of each time and the log of the sum of its hazards, the number of events, and the sum of
    (log hazard - top) over those. Rows are added up at coarse levels of the log hazard first, so that nothing overflows or vanishes
    before the top of a time is known."""
    h = F.col(log_hazard).cast("double")
    rows = src.select(*keys, F.col(time).alias("time"), h.alias("h"), F.col(event).cast("bigint").alias("e"), (F.floor(h / 64) * 64).cast("double").alias("level"))
    near = rows.groupBy(*keys, "time", "level").agg(F.max("h").alias("hi"), F.sum(F.exp(F.col("h") - F.col("level"))).alias("s"), F.sum("e").alias("d"), F.sum(F.col("e") * (F.col("h") - F.col("level"))).alias("dh"))
    each = near.groupBy(*keys, "time").agg(F.max("hi").alias("top"), F.collect_list(F.struct("level", "s", "d", "dh")).alias("parts"))
    added = lambda f: F.aggregate("parts", F.lit(0.0), lambda total, x: total + f(x))
    return each.select(*keys, "time", "top", (F.col("top") + F.log(added(lambda x: x["s"] * F.exp(x["level"] - F.col("top"))))).alias("log"),
                       F.aggregate("parts", F.lit(0).cast("bigint"), lambda total, x: total + x["d"]).alias("d"), added(lambda x: x["dh"] + x["d"] * (x["level"] - F.col("top"))).alias("dh"))


def concordance(df: DataFrame, log_hazard: str, by: Sequence[str] = (), time: str = "time", event: str = "event") -> DataFrame:
    """Harrell's concordance: an event is compared with every later time and with rows censored at
    the same time; equal predictions count one half.

    Counting is by levels of a binary tree over time ranks: two ranks separate at exactly one
    level, so pairs are counted once, as running totals over the prediction inside each node.
    Rows multiply by the number of levels (log2 of distinct times), never by their partners.
    """
    keys = list(by) or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    # censored rows sort just after events of the same time
    late = F.when(F.col(event) == 1, 0).otherwise(1)
    rows = src.select(*keys, F.col(time).cast("double").alias("_t"), late.alias("_c"), F.col(log_hazard).alias("_h"))
    rows = cut(rows.groupBy(*keys, "_t", "_c", "_h").agg(F.count(F.lit(1)).alias("_n")))
    ranks = od.running_totals(rows.select(*keys, "_t").distinct().withColumn("_one", F.lit(1).cast("bigint")), keys, "_t", ["_one"])
    ranks = cut(ranks.select(*keys, "_t", "cum__one"))
    levels = max(1, int(ranks.agg(F.max("cum__one")).first()[0] * 2).bit_length())
    joined = rows.join(ranks, [*keys, "_t"]).withColumn("_r", F.col("cum__one") * 2 + F.col("_c"))
    up = joined.withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    side = F.expr("shiftright(_r, _lvl) & 1")
    node = up.select(*keys, "_lvl", F.expr("shiftright(_r, _lvl + 1)").alias("_node"), "_h",
                     F.when((side == 0) & (F.col("_c") == 0), F.col("_n")).otherwise(0).alias("_ev"),
                     F.when(side == 1, F.col("_n")).otherwise(0).alias("_lt"))
    groups = [*keys, "_lvl", "_node"]
    run = od.running_totals(node, groups, "_h", ["_ev", "_lt"])
    # a later row with prediction h is concordant with earlier events of higher hazard
    lower = F.col("cum__lt") - F.col("_lt")
    out = run.groupBy(*keys).agg(
        F.sum((F.col("_ev") * (lower + F.col("_lt") / F.lit(2.0)))).alias("_good"))
    totals = node.groupBy(*groups).agg(F.sum("_ev").alias("_e"), F.sum("_lt").alias("_l"))
    pairs = totals.groupBy(*keys).agg(F.sum(F.col("_e") * F.col("_l")).alias("pairs"))
    res = out.join(pairs, keys).select(*keys, "pairs", F.when(F.col("pairs") > 0, F.col("_good") / F.col("pairs")).alias("c_index"))
    return res if by else res.drop("_all")


def route_comparison(df: DataFrame, ties: str = "efron") -> DataFrame:
    """Naive, predictor-substitution, residual-inclusion and oracle fits side by side, in the same passes (rows need
    x, xhat, u; those without one of them count in no route)."""
    rows = df.withColumn("resid", F.col("x") - F.col("xhat"))
    routes = {"naive": ["x"], "2SPS": ["xhat"], "2SRI": ["x", "resid"], "oracle": ["x", "u"]}
    fits = fit_models(rows, list(routes.values()), ties=ties)
    return df.sparkSession.createDataFrame([(name, float(beta[0]), float(np.sqrt(cov[0, 0]))) for name, (beta, cov, _) in zip(routes, fits)], "route string, beta double, se double")


def risk_sets(df: DataFrame, value: Column, strata: Sequence[str] = ("site",), time: str = "time") -> DataFrame:
    """Sum of `value` over everyone still at risk at each distinct time (ties see the whole tie)."""
    return od.running_totals(df.select(*strata, F.col(time).alias("time"), value.alias("s0"),
                                       F.lit(1).cast("bigint").alias("at_risk")),
                             list(strata), "time", ["s0", "at_risk"], descending=True)
