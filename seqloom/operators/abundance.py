"""Abundance from equivalence classes: initial means, EM and VB steps, acceleration, likelihood, units.

State is a table (tid, mass); classes are (class_key, cnt) and their targets (class_key, tid, occ).  A step is two
aggregations over the class-target pairs.  Pairs are far fewer than k-mers or reads, which is why classes are built
first; when even they are many, the loop writes its state every few steps and goes on from the written table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import Workspace

PRIOR = 0.01
EPSILON = 0.375e-10


def digamma(x: Column) -> Column:
    """Digamma for x > 0: recurrence up to x + 6, then the asymptotic series; the error is below 1e-11."""
    head = sum((F.lit(1.0) / (x + i) for i in range(1, 6)), F.lit(1.0) / x)
    y = x + F.lit(6.0)
    r = F.lit(1.0) / (y * y)
    series = r * (F.lit(1 / 12) - r * (F.lit(1 / 120) - r * (F.lit(1 / 252) - r * (F.lit(1 / 240) - r * F.lit(1 / 132)))))
    return F.log(y) - F.lit(0.5) / y - series - head


def initial_means(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tid, mean): multiplicity x class count / promiscuity, normalised to sum to 1. ``classes``: class_key, cnt, promiscuity."""
    raw = pairs.join(classes, "class_key").groupBy("tid").agg(F.sum(F.col("occ") * F.col("cnt") / F.col("promiscuity")).alias("raw"))
    return normalise(raw, "raw", "mean").select("tid", "mean")


def normalise(df: DataFrame, column: str, out: str) -> DataFrame:
    """Divide by the sum over all rows; the sum is one row, joined to the rows rather than taken over one window."""
    total = df.agg(F.sum(column).alias("__total"))
    return df.join(F.broadcast(total)).withColumn(out, F.when(F.col("__total") > 0, F.col(column) / F.col("__total")).otherwise(F.lit(0.0))).drop("__total")


def vb_step(means: DataFrame, classes: DataFrame, pairs: DataFrame, lengths: DataFrame, prior: float = PRIOR, least: float = 1.0) -> DataFrame:
    """(tid, mean) after one step of the variational EM.

    With total = prior x targets + sum of class counts, the weight of a target with count c = mean x total, at least ``least``
    and not 0, is exp(digamma(c) - digamma(total)) / effective length, that of others 0; each class count is divided among its
    targets by weight, and the new mean is prior + mass, normalised.  ``lengths``: tid, eff_len, for every target.
    """
    sizes = lengths.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(classes.agg(F.sum("cnt").alias("c"))))  # two single rows
    total = sizes.select((F.lit(prior) * F.col("n") + F.col("c")).alias("__t"))
    count = F.col("mean") * F.col("__t")
    weighted = lengths.join(means, "tid", "left").na.fill(0.0, ["mean"]).join(F.broadcast(total)).select(
        "tid", F.when((count >= least) & (count > 0) & (F.col("eff_len") > 0), F.exp(digamma(count) - digamma(F.col("__t"))) / F.col("eff_len")).otherwise(F.lit(0.0)).alias("rho")
    )
    return _split(weighted, classes, pairs, prior)


def em_step(means: DataFrame, classes: DataFrame, pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(tid, mean) after one plain EM step: class counts are divided in proportion to mean / effective length."""
    weighted = lengths.join(means, "tid", "left").na.fill(0.0, ["mean"]).select("tid", F.when(F.col("eff_len") > 0, F.col("mean") / F.col("eff_len")).otherwise(F.lit(0.0)).alias("rho"))
    return _split(weighted, classes, pairs, 0.0)


def _split(weighted: DataFrame, classes: DataFrame, pairs: DataFrame, prior: float) -> DataFrame:
    p = pairs.join(weighted, "tid")
    norm = p.groupBy("class_key").agg(F.sum("rho").alias("whole")).where(F.col("whole") > EPSILON)
    mass = p.join(norm.join(classes.select("class_key", "cnt"), "class_key"), "class_key").groupBy("tid").agg(F.sum(F.col("rho") / F.col("whole") * F.col("cnt")).alias("mass"))
    every = weighted.select("tid").join(mass, "tid", "left").select("tid", (F.lit(prior) + F.coalesce("mass", F.lit(0.0))).alias("raw"))
    return normalise(every, "raw", "mean").select("tid", "mean")


def iterate(means: DataFrame, classes: DataFrame, pairs: DataFrame, lengths: DataFrame, rounds: int, step=vb_step, keep_every: int = 1, tolerance: float | None = None) -> DataFrame:
    """Up to ``rounds`` steps; the state is written every ``keep_every`` steps, so no plan grows beyond that. With
    ``tolerance``, ends when no target's mean changes by more than that share of it (successive iterates are compared)."""
    ws = Workspace(means.sparkSession, "em")
    classes, pairs, lengths = (ws.write(x, n) for x, n in ((classes, "classes"), (pairs, "pairs"), (lengths, "lengths")))
    now = ws.write(means, "means-0")
    last = 0
    for i in range(1, rounds + 1):
        new = step(now, classes, pairs, lengths)
        if i % keep_every == 0 or i == rounds:
            new = ws.write(new, f"means-{i}")
            if tolerance is not None:
                a = new.join(now.withColumnRenamed("mean", "before"), "tid")
                change = a.where("mean > 1e-8").agg(F.max(F.abs(F.col("mean") - F.col("before")) / F.col("mean"))).first()[0]
                if change is None or change < tolerance:
                    return new
            if last:
                ws.drop(f"means-{last}")
            last = i
        now = new
    return now


class _Tables:
    """Means as written tables; every operation is a query over the class-target pairs."""

    def __init__(self, classes: DataFrame, pairs: DataFrame, lengths: DataFrame, prior: float, least: float):
        self.ws, self.n = Workspace(pairs.sparkSession, "solve"), 0
        self.classes, self.pairs, self.lengths = (self.ws.write(x, n) for x, n in ((classes, "classes"), (pairs, "pairs"), (lengths, "lengths")))
        self.prior, self.least = prior, least

    def keep(self, means: DataFrame) -> DataFrame:
        self.n += 1
        return self.ws.write(means.select("tid", "mean"), f"means-{self.n}")

    def step(self, m: DataFrame) -> DataFrame:
        return self.keep(vb_step(m, self.classes, self.pairs, self.lengths, self.prior, self.least))

    def _join(self, *means: DataFrame) -> DataFrame:
        j = self.lengths.select("tid")
        for i, m in enumerate(means):
            j = j.join(m.select("tid", F.col("mean").alias(f"m{i}")), "tid", "left").na.fill(0.0, [f"m{i}"])
        return j

    def change(self, a: DataFrame, b: DataFrame) -> float:
        x, y = F.col("m0"), F.col("m1")
        share = F.when(x > 0, F.abs(y - x) / x).otherwise(F.lit(float("inf")))
        return self._join(a, b).where((x > 1e-7) | (y > 1e-7)).agg(F.max(share)).first()[0] or 0.0

    def likelihood(self, m: DataFrame) -> float:
        row = log_likelihood(m, self.classes, self.pairs, self.lengths, 3).first()
        return row[0] or 0.0

    def norms(self, m0: DataFrame, m1: DataFrame, m2: DataFrame) -> tuple[float, float]:
        r = F.col("m1") - F.col("m0")
        v = F.col("m2") - F.col("m1") - r
        x = self._join(m0, m1, m2).agg(F.sum(r * r), F.sum(v * v)).first()
        return math.sqrt(x[0] or 0.0), math.sqrt(x[1] or 0.0)

    def ahead(self, m0: DataFrame, m1: DataFrame, m2: DataFrame, alpha: float) -> DataFrame:
        r = F.col("m1") - F.col("m0")
        v = F.col("m2") - F.col("m1") - r
        return self.keep(self._join(m0, m1, m2).select("tid", F.greatest(F.col("m0") * 0.1, F.col("m0") + 2 * alpha * r + alpha * alpha * v).alias("mean")))


class _Arrays:
    """Means as arrays in one task. c, t: class and target of each pair; cnt: per class; length: per target."""

    def __init__(self, c: np.ndarray, t: np.ndarray, cnt: np.ndarray, length: np.ndarray, prior: float, least: float):
        self.c, self.t, self.cnt, self.length, self.prior, self.least = c, t, cnt, length, prior, least
        self.total = prior * len(length) + cnt.sum()
        self.psi = _digamma(np.array([self.total]))[0]

    def step(self, m: np.ndarray) -> np.ndarray:
        n = m * self.total
        ok = (n >= self.least) & (n > 0) & (self.length > 0)
        rho = np.zeros(len(m))
        rho[ok] = np.exp(_digamma(n[ok]) - self.psi) / self.length[ok]
        whole = np.bincount(self.c, rho[self.t], len(self.cnt))
        share = np.where(whole > EPSILON, self.cnt / np.where(whole > EPSILON, whole, 1.0), 0.0)
        new = self.prior + np.bincount(self.t, rho[self.t] * share[self.c], len(m))
        return new / new.sum() if new.sum() > 0 else new

    def change(self, a: np.ndarray, b: np.ndarray) -> float:
        seen = (a > 1e-7) | (b > 1e-7)
        a, b = a[seen], b[seen]
        return float(np.where(a > 0, np.abs(b - a) / np.where(a > 0, a, 1.0), np.inf).max(initial=0.0))

    def likelihood(self, m: np.ndarray) -> float:
        p = np.where(self.length > 0, m / np.where(self.length > 0, self.length, 1.0), 0.0)
        p = p / p.sum() if p.sum() > 0 else p
        seen = p > EPSILON
        log_p = np.zeros(len(p))
        log_p[seen] = np.log(p[seen] / self.length[seen])
        return float((self.cnt[self.c] * log_p[self.t]).sum()) / max(len(m), 1)

    def norms(self, m0, m1, m2) -> tuple[float, float]:
        r = m1 - m0
        v = m2 - m1 - r
        return float(np.sqrt((r * r).sum())), float(np.sqrt((v * v).sum()))

    def ahead(self, m0, m1, m2, alpha: float) -> np.ndarray:
        r = m1 - m0
        return np.maximum(m0 * 0.1, m0 + 2 * alpha * r + alpha * alpha * (m2 - m1 - r))


def drive(ops, m, rounds: int, tolerance: float | None, accelerate: bool):
    """(means, rounds taken, whether they converged) of the fixed-point iteration over :class:`_Tables` or :class:`_Arrays`.

    It has converged when no mean above 1e-7 changes in a step by ``tolerance`` of it or more. With ``accelerate`` a round, once changes
    are below ten times that (from the start without a tolerance), extrapolates along two steps (SQUAREM): step lengths are
    from 1 to a bound that is 1 at first and quadruples when it is reached; no mean falls below a tenth of what it was; a length
    other than 1 is followed by a stabilising step; and if the likelihood falls by more than 1, the two steps are taken as they are.
    """
    accelerated, last, bound = tolerance is None and accelerate, None, 1.0
    for i in range(1, rounds + 1):
        one = ops.step(m)
        if tolerance is not None:
            change = ops.change(m, one)
            if change < tolerance:
                return one, i, True
            accelerated = accelerated or accelerate and change < 10 * tolerance
        if not accelerated:
            m = one
            continue
        last = -ops.likelihood(m) if last is None else last
        two = ops.step(one)
        r, v = ops.norms(m, one, two)
        alpha = max(1.0, min(bound, r / v if v > 0 else bound))
        new = ops.ahead(m, one, two, alpha)
        if abs(alpha - 1.0) > 0.01:
            new = ops.step(new)
        now = -ops.likelihood(new)
        if now > last + 1.0:
            new, now = two, -ops.likelihood(two)
            if alpha == bound:
                bound = max(1.0, bound / 4.0)
            alpha = 1.0
        if alpha == bound:
            bound *= 4.0
        m, last = new, now
    return m, rounds, False


def _digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6.0
    r = 1.0 / (y * y)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return np.log(y) - 0.5 / y - series - sum(1.0 / (x + i) for i in range(6))


def solve(means: DataFrame, classes: DataFrame, pairs: DataFrame, lengths: DataFrame, rounds: int = 1000, tolerance: float | None = None, accelerate: bool = False, prior: float = PRIOR, least: float = 1.0, most_pairs: int = 2_000_000) -> DataFrame:
    """(tid, mean, rounds, converged): :func:`drive` with the steps of :func:`vb_step`, for every target of ``lengths``.

    Up to ``most_pairs`` class-target pairs (some 100 MB) all rounds run inside one task, as a round then costs less
    than scheduling it; beyond that every operation is a query over tables. Both take the same steps in the same order.
    """
    ws = Workspace(means.sparkSession, "solve")
    start = lengths.join(means, "tid", "left").na.fill(0.0, ["mean"]).select("tid", "eff_len", "mean")
    one = start.join(pairs.join(classes.select("class_key", "cnt"), "class_key").select("tid", "class_key", "cnt"), "tid", "left")
    one = ws.write(one.select("class_key", "tid", "cnt", "eff_len", "mean"), "pairs")
    if one.count() > most_pairs:
        ops = _Tables(classes, pairs, lengths, prior, least)
        m, n, done = drive(ops, ops.keep(start), rounds, tolerance, accelerate)
        return m.select("tid", "mean", F.lit(n).alias("rounds"), F.lit(done).alias("converged"))

    def run(frames):
        import pandas as pd

        x = pd.concat(list(frames))
        if not len(x):
            return
        t, tids = pd.factorize(x["tid"])
        length, mean = np.zeros(len(tids)), np.zeros(len(tids))
        length[t], mean[t] = x["eff_len"], x["mean"]
        has = x["class_key"].notna().to_numpy()
        c, keys = pd.factorize(x["class_key"][has])
        cnt = np.zeros(len(keys))
        cnt[c] = x["cnt"][has]
        mean, n, done = drive(_Arrays(c, t[has], cnt, length, prior, least), mean, rounds, tolerance, accelerate)
        yield pd.DataFrame({"tid": tids, "mean": mean, "rounds": n, "converged": done})

    return one.coalesce(1).mapInPandas(run, "tid long, mean double, rounds int, converged boolean")


def log_likelihood(means: DataFrame, classes: DataFrame, pairs: DataFrame, lengths: DataFrame, variant: int = 0, prior: float = PRIOR, least: float = 1.0) -> DataFrame:
    """One row, ``log_likelihood``, of means (tid, mean).

    0: that of the mixture: sum over classes of count x ln(sum over targets of mean / effective length).
    1: over targets, ln(mean x product over classes of the share of the class it gets); products below 1e-40 add nothing.
    2: over classes, ln(sum over targets of the mass it gets of the class x p / effective length), left out below 1e-20.
    3: over class-target pairs, count x ln(p / effective length), divided by the number of targets: the one that guards the acceleration.
    p is mean / effective length, normalised; shares and masses are those of a step from these means. Targets without an effective length and
    probabilities of 0 are left out.
    """
    kept = lengths.join(means.select("tid", "mean"), "tid", "left").na.fill(0.0, ["mean"])
    if variant == 0:
        p = pairs.join(kept, "tid").where("eff_len > 0").groupBy("class_key").agg(F.sum(F.col("mean") / F.col("eff_len")).alias("p"))
        return p.join(classes, "class_key").where("p > 0").agg(F.sum(F.col("cnt") * F.log("p")).alias("log_likelihood"))
    kept = normalise(kept.withColumn("raw", F.when(F.col("eff_len") > 0, F.col("mean") / F.col("eff_len")).otherwise(F.lit(0.0))), "raw", "p")
    if variant == 3:
        n = lengths.agg(F.count(F.lit(1)).alias("n"))
        x = pairs.join(kept.where(F.col("p") > EPSILON), "tid").join(classes.select("class_key", "cnt"), "class_key")
        x = x.agg(F.sum(F.col("cnt") * F.log(F.col("p") / F.col("eff_len"))).alias("x"))
        return x.join(F.broadcast(n)).select((F.col("x") / F.col("n")).alias("log_likelihood"))  # two single rows
    sizes = lengths.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(classes.agg(F.sum("cnt").alias("c"))))
    count = F.col("mean") * F.col("__t")
    rho = F.when((count >= least) & (count > 0) & (F.col("eff_len") > 0), F.exp(digamma(count) - digamma(F.col("__t"))) / F.col("eff_len")).otherwise(F.lit(0.0))
    kept = kept.join(F.broadcast(sizes.select((F.lit(prior) * F.col("n") + F.col("c")).alias("__t")))).withColumn("rho", rho)
    x = pairs.join(kept.select("tid", "eff_len", "mean", "p", "rho"), "tid")
    whole = x.groupBy("class_key").agg(F.sum("rho").alias("whole")).where(F.col("whole") > EPSILON)
    x = x.join(whole.join(classes.select("class_key", "cnt").where("cnt > 0"), "class_key"), "class_key").withColumn("share", F.col("rho") / F.col("whole"))
    if variant == 1:
        log_share = F.sum(F.when(F.col("share") > 0, F.log("share")).otherwise(F.lit(-1e9)))
        x = x.groupBy("tid").agg(F.max("mean").alias("mean"), log_share.alias("l")).where(f"mean > 1e-40 and l > {math.log(1e-40)!r}")
        return x.agg(F.coalesce(F.sum(F.log("mean") + F.col("l")), F.lit(0.0)).alias("log_likelihood"))
    per = x.where("eff_len > 0").groupBy("class_key").agg(F.sum(F.col("share") * F.col("cnt") * F.col("p") / F.col("eff_len")).alias("l"))
    return per.where("l >= 1e-20").agg(F.coalesce(F.sum(F.log("l")), F.lit(0.0)).alias("log_likelihood"))


def smoothed_biases(means: DataFrame, classes: DataFrame, pairs: DataFrame, lengths: DataFrame, alpha: float = 0.25, prior: float = PRIOR, least: float = 1.0) -> DataFrame:
    """(class_key, bias): how far a class is under- (above 1) or overrepresented, as its targets vote, each by its fidelity.

    A target's coverage is what it gets of all classes in a step from ``means``, over its effective length. Its fidelity is 1 / (1 + mean
    deviation of what it gets of a class from coverage x size of the class); k-mers of classes of which it gets nothing deviate by the coverage.
    The vote is coverage x size over what it gets; the bias moves by ``alpha`` from 1 to the mean vote. ``classes``: class_key, cnt, size.
    """
    sizes = lengths.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(classes.agg(F.sum("cnt").alias("c"))))  # two single rows
    count = F.col("mean") * F.col("__t")
    kept = lengths.join(means.select("tid", "mean"), "tid", "left").na.fill(0.0, ["mean"]).join(F.broadcast(sizes.select((F.lit(prior) * F.col("n") + F.col("c")).alias("__t"))))
    rho = F.when((count >= least) & (count > 0) & (F.col("eff_len") > 0), F.exp(digamma(count) - digamma(F.col("__t"))) / F.col("eff_len")).otherwise(F.lit(0.0))
    x = pairs.select("class_key", "tid").join(kept.select("tid", "eff_len", rho.alias("rho")), "tid")
    whole = x.groupBy("class_key").agg(F.sum("rho").alias("whole"))
    x = x.join(whole, "class_key").join(classes.select("class_key", "cnt", "size"), "class_key")
    x = x.withColumn("gets", F.when(F.col("whole") > EPSILON, F.col("rho") / F.col("whole") * F.col("cnt")).otherwise(F.lit(0.0)))
    x = x.join(x.groupBy("tid").agg((F.sum("gets") / F.max("eff_len")).alias("coverage"), F.count(F.lit(1)).alias("n_classes")), "tid")
    fidelity = x.groupBy("tid").agg((F.sum(F.abs(F.col("gets") - F.col("coverage") * F.col("size"))) + F.max("coverage") * F.greatest(F.max("eff_len") - F.max("n_classes"), F.lit(0))).alias("off"), F.max("eff_len").alias("n"))
    fidelity = fidelity.select("tid", (1 / (1 + F.col("off") / F.col("n"))).alias("fidelity"))
    vote = F.when(F.col("gets") > 0, F.col("fidelity") * F.col("coverage") * F.col("size") / F.col("gets")).otherwise(F.lit(0.0))
    b = x.join(fidelity, "tid").groupBy("class_key").agg((F.sum(vote) / F.sum("fidelity")).alias("vote"))
    return b.select("class_key", (alpha * F.col("vote") + (1 - alpha)).alias("bias"))


def kmer_units(masses: DataFrame, k: int, mean_read_length: float, least: float = 0.0) -> DataFrame:
    """(tid, tpm, rpkm, kpkm, est_kmers, est_reads) of masses (tid, eff_len, mass); all units are 0 where kpkm < ``least``."""
    per_read = mean_read_length - k + 1
    t = masses.withColumn("per", F.when(F.col("eff_len") > 0, F.col("mass") / F.col("eff_len")).otherwise(F.lit(0.0)))
    totals = t.agg(F.sum("mass").alias("__m"), F.sum("per").alias("__p"))
    t = t.join(F.broadcast(totals))
    reads = F.col("mass") / per_read
    read_length = F.col("eff_len") + (k - 1) - math.floor(mean_read_length) + 1
    kpkm = F.when(F.col("eff_len") > 0, F.col("mass") * 1e9 / (F.col("eff_len") * F.col("__m"))).otherwise(0.0)
    rpkm = F.when(read_length > 0, reads * 1e9 / (read_length * (F.col("__m") / per_read))).otherwise(0.0)
    kept = lambda c: F.when(kpkm < least, F.lit(0.0)).otherwise(c)
    return t.select("tid", kept(F.col("per") / F.col("__p") * 1e6).alias("tpm"), kept(rpkm).alias("rpkm"), kept(kpkm).alias("kpkm"), kept(F.col("mass")).alias("est_kmers"), kept(reads).alias("est_reads"))


def read_units(counts: DataFrame) -> DataFrame:
    """(tid, tpm, fpkm, num_reads) of projected counts (tid, length, num_reads)."""
    totals = counts.agg(F.sum("num_reads").alias("__n"), F.sum(F.when(F.col("length") > 0, F.col("num_reads") / F.col("length"))).alias("__d"))
    c = counts.join(F.broadcast(totals))
    fpkm = F.when((F.col("num_reads") > 0) & (F.col("length") > 0), F.col("num_reads") * 1e9 / (F.col("length") * F.col("__n"))).otherwise(0.0)
    tpm = F.when(F.col("length") > 0, F.col("num_reads") / F.col("length") / F.col("__d") * 1e6).otherwise(0.0)
    return c.select("tid", tpm.alias("tpm"), fpkm.alias("fpkm"), "num_reads")


def clamped_sums(df: DataFrame, key: str, value: str, quantile: float) -> DataFrame:
    """(key, clamped, between_quantiles): sums of the values of a key with its lowest and highest ones replaced by the next different
    ones (plain sums below five values), and with all values clamped to the given quantile and its counterpart."""
    v = F.col(value)
    b = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(v).alias("__total"), F.min(v).alias("__low"), F.max(v).alias("__high"),
        F.percentile(v, F.lit(quantile)).alias("__q1"), F.percentile(v, F.lit(1 - quantile)).alias("__q2"),
    )
    x = df.select(key, value).join(b, key)
    c = x.groupBy(key).agg(F.min(F.when(v > F.col("__low"), v)).alias("__low2"), F.max(F.when(v < F.col("__high"), v)).alias("__high2"))
    x = x.join(c, key).withColumn("__c", F.when(F.col("__n") < 5, v).when(v >= F.col("__high"), F.coalesce("__high2", "__high")).when(v <= F.col("__low"), F.coalesce("__low2", "__low")).otherwise(v))
    return x.groupBy(key).agg(F.sum("__c").alias("clamped"), F.sum(F.least("__q2", F.greatest("__q1", v))).alias("between_quantiles"))


def roll_up(expression: DataFrame, t2g: DataFrame, tid: str = "tid", gene: str = "gene") -> DataFrame:
    """Per gene the greatest length and the sum of every other number; a target without a gene is its own gene."""
    values = [c for c, kind in expression.dtypes if c not in (tid, "length") and kind in ("double", "float", "int", "bigint")]
    j = expression.join(t2g.dropDuplicates([tid]), tid, "left").withColumn("gene", F.coalesce(F.col(gene).cast("string"), F.col(tid).cast("string")))
    return j.groupBy("gene").agg(F.max("length").alias("length"), *(F.sum(v).alias(v) for v in values))


def project_to_polytope(counts: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(cluster, tid, count): estimated counts of a cluster clamped to [unique, total], the rest rescaled, until all fit.

    ``counts``: cluster, tid, est, uniq, total.  A cluster is one group of targets that share reads; the clamping needs
    its targets together, so it runs as one grouped-map call a cluster.
    """

    def run(pdf):
        est, lo, hi = (pdf[c].to_numpy(float) for c in ("est", "uniq", "total"))
        pdf = pdf[["cluster", "tid"]].copy()
        pdf["count"] = clamp(est, lo, hi, rounds)
        return pdf

    return counts.groupBy("cluster").applyInPandas(run, "cluster long, tid long, count double")


def clamp(est: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: int) -> np.ndarray:
    """Clamp to [lo, hi]; what the clamped values leave of the sum goes to the free ones in proportion. When none is free
    and the sum is not met, all are free again."""
    x, whole = est.astype(float), float(est.sum())
    held = np.zeros(len(x), bool)
    for _ in range(rounds):
        held |= (x > hi) | (x < lo)
        x = np.where(x > hi, hi, np.where(x < lo, lo, x))
        if abs(x.sum() - whole) < EPSILON * max(1.0, whole):
            break
        if x[~held].sum() == 0:
            held[:] = False
        free = x[~held].sum()
        if free == 0:
            break
        x[~held] *= (whole - x[held].sum()) / free
    return x


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: recurrence up to x + 8, then Stirling's series."""
    y, shift = x + 8.0, np.zeros(len(x))
    for i in range(8):
        shift += np.log(x + i)
    r = 1.0 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, for 0 < x < 1; its continued fraction by the modified Lentz method, for all rows at once."""
    turned = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    front = np.exp(p * np.log(np.maximum(z, 1e-300)) + q * np.log1p(-z) + _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)) / p
    away = lambda u: np.where(np.abs(u) < 1e-300, 1e-300, u)
    c, d = np.ones(len(x)), 1.0 / away(1 - (p + q) * z / (p + 1))
    f, left = d.copy(), np.arange(len(x))  # rows that have not converged go on
    value = d.copy()
    for m in range(1, 20_000):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1.0 / away(1 + even * d), away(1 + even / c)
        f = f * c * d
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1.0 / away(1 + odd * d), away(1 + odd / c)
        f = f * c * d
        go = np.abs(c * d - 1) >= 1e-14
        if not go.all():
            value[left[~go]] = f[~go]
            p, q, z, c, d, f, left = (v[go] for v in (p, q, z, c, d, f, left))
            if not len(left):
                break
    value[left] = f
    out = front * value
    return np.where(turned, 1 - out, out)


def beta_quantile(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Quantile of Beta(a, b): Newton's method for ln F(ln x), which is concave, from the mean; a step that leaves the bracket halves it."""
    low, high, x = np.zeros(len(a)), np.ones(len(a)), np.clip(a / (a + b), 1e-300, 1 - 1e-16)
    log_beta = _log_gamma(a) + _log_gamma(b) - _log_gamma(a + b)
    left = np.arange(len(a))
    for _ in range(100):
        if not len(left):
            break
        u, al, bl = x[left], a[left], b[left]
        f = incomplete_beta(al, bl, u)
        less = f < p
        low[left], high[left] = np.where(less, u, low[left]), np.where(less, high[left], u)
        with np.errstate(all="ignore"):
            slope = np.exp(al * np.log(u) + bl * np.log1p(-u) - log_beta[left]) / f
            new = u * np.exp((math.log(p) - np.log(f)) / slope)
        outside = ~((new > low[left]) & (new < high[left]))
        new = np.where(outside, (low[left] + high[left]) / 2, new)
        x[left] = new
        left = left[(np.abs(new - u) > 1e-9 * u) & (high[left] - low[left] > 1e-18)]
    return x


def intervals(means: DataFrame, classes: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(tid, mean, low, high): posterior share of each target and its central 95 % interval, of the converged means (tid, mean) of :func:`solve`
    under a Dirichlet prior ``alpha``: the parameter of a target is its mean times the total, and its share has a beta distribution."""
    # read twice, so written: the rounds of solve are not taken again
    means = Workspace(means.sparkSession, "intervals").write(means.select("tid", "mean"), "means")
    total = means.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(classes.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("c"))))  # two single rows
    x = means.join(F.broadcast(total.select((F.lit(alpha) * F.col("n") + F.col("c")).alias("t")))).select("tid", "mean", (F.col("mean") * F.col("t")).alias("a"), ((1 - F.col("mean")) * F.col("t")).alias("b"))

    def run(frames):
        for f in frames:
            a, b = f["a"].to_numpy(float), f["b"].to_numpy(float)
            ok = (a > 0) & (b > 0)
            low, high = np.where(a > 0, f["mean"], 0.0), np.where(a > 0, f["mean"], 0.0)
            low[ok], high[ok] = beta_quantile(a[ok], b[ok], 0.025), beta_quantile(a[ok], b[ok], 0.975)
            yield f[["tid", "mean"]].assign(low=low, high=high)

    # few rows, of much work each: as many tasks as there are cores
    return x.repartition(x.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "tid long, mean double, low double, high double")


def running_log_mass(n: Column, forgetting: float) -> Column:
    """Increment of the log forgetting mass at mini-batch n >= 2."""
    return forgetting * F.log(n - 1) - F.log(F.pow(n, F.lit(forgetting)) - 1)


def forgetting_schedule(batches: DataFrame, n: str, forgetting: float = 0.65) -> DataFrame:
    """(n, log_mass): running sum of the increments; the table has one row a mini-batch, and batch 1 has log mass 0."""
    step = F.when(F.col(n) > 1, running_log_mass(F.col(n).cast("double"), forgetting)).otherwise(F.lit(0.0))
    return batches.select(F.col(n).alias("n"), F.sum(step).over(Window.orderBy(n)).alias("log_mass"))
