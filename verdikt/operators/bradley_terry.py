"""Penalised Bradley-Terry strengths with a side term, many fits at once.

A fit is a value of ``scope`` (a season) and a lane: a penalty, and the periods whose rounds count. Lanes share their rounds:
a round is one row whatever the number of lanes, and says by its period in which it counts. So the fits of a walk-forward
validation, one for each prefix of the periods, copy no round and take as many passes as the slowest of them alone.

All descend together by L-BFGS, each variable scaled by a bound of the curvature, ``penalty + rounds * subjects in a round / 4``.
The objective is strictly convex, and a lane stops at a gradient (so scaled) of ``GRADIENT``. A step sends strengths to the rounds and pulls
back to the subjects; what it needs besides are the dot products of a few vectors, so a lane sends a few dozen sums to the
driver and gets as many coefficients back, however large it is. The side term is one number a lane and stays on the
driver; no row of it exists. Rounds stay where they are: strengths come to them by a join for each seat, and what goes back is
summed by subject in the task first. No row by round is written in a pass, nor shuffled where strengths are small enough to be
broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from verdikt.operators.glicko import ballot_score
from verdikt.operators.lineage import cut_lineage

# The descent's defaults.
LAMBDA, ITERATIONS = 1.5, 400
#: Where a lane stops: the length of its scaled gradient. Strengths then stand within about as much of their optimum.
GRADIENT = 1e-7
#: Bytes of strengths, over all fits and lanes, up to which they are broadcast to the rounds; above, rounds are joined by shuffles.
BROADCAST = 16_000_000
#: Differences that a step remembers, and how often it may be halved.
MEMORY, HALVINGS = 6, 12


class Lane(NamedTuple):
    """One fit of every season: its name, its penalty, and the first period that no longer counts (None: all count)."""

    name: object
    penalty: float = LAMBDA
    before: int | None = None


def bt_rounds(rounds: DataFrame, margin_weight: float = 1.0, unit: str = "pairs") -> DataFrame:
    """Rounds as arrays of subjects: the pair itself, or its people."""
    ids = (lambda c: F.array(c)) if unit == "pairs" else (lambda c: F.split(c, r"\|"))
    return (rounds.withColumn("score", ballot_score("won_a", "ballots", margin_weight))
            .withColumn("side", F.when(F.col("side_a") == 1, 1.0).otherwise(-1.0))
            .withColumn("side_a_ids", ids(F.col("a"))).withColumn("side_b_ids", ids(F.col("b"))))


def _members(rounds: DataFrame, keys: list[str]) -> DataFrame:
    sign = lambda ids, s: F.transform(ids, lambda i: F.struct(i.alias("subject"), F.lit(s).alias("sign")))
    return rounds.select(*keys, F.explode(F.concat(sign(F.col("side_a_ids"), 1.0), sign(F.col("side_b_ids"), -1.0)))
                         .alias("m")).select(*keys, "m.subject", "m.sign")


def _direction(dots: np.ndarray, kept: int) -> np.ndarray:
    """Coefficients of the quasi-Newton step over the vectors s1..sk, y1..yk, g, from their dot products."""
    out = np.zeros(2 * kept + 1)
    out[-1] = -1.0
    used = [i for i in range(kept) if dots[i, kept + i] > 1e-20]
    alpha = {}
    for i in reversed(used):
        alpha[i] = out @ dots[:, i] / dots[i, kept + i]
        out[kept + i] -= alpha[i]
    if used:
        last = used[-1]
        out *= dots[last, kept + last] / dots[kept + last, kept + last]
    for i in used:
        out[i] += alpha[i] - out @ dots[:, kept + i] / dots[i, kept + i]
    return out


def _array(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch[name].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1, width)


def _lists(values: np.ndarray) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * np.int32(flat.shape[1])), pa.array(flat.ravel()))


_STATE = "_fit int, subject string, root array<double>, past array<double>, u array<double>, g array<double>, to array<double>, h array<double>"
_MOVED = "_fit int, subject string, root array<double>, past array<double>, u array<double>, g array<double>, to array<double>, x array<double>"


def _remembered(past: np.ndarray, s: np.ndarray, y: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """``past`` (first axis or second but one: s1..sk, y1..yk; last: lanes) with one more pair, at most ``MEMORY``.

    A lane that has not taken its step keeps its pairs, and an empty one before them where the others have grown.
    """
    kept = past.shape[1] // 2
    grow = kept < MEMORY
    old = [past[:, :kept], past[:, kept:]]
    gone_on = [np.concatenate([o, n[:, None]], axis=1)[:, -MEMORY:] for o, n in zip(old, (s, y))]
    stayed = [np.concatenate([np.zeros_like(o[:, :1]) if o.shape[1] else np.zeros_like(n[:, None]), o], axis=1) if grow else o for o, n in zip(old, (s, y))]
    return np.concatenate([np.where(taken[:, None], a, b) for a, b in zip(gone_on, stayed)], axis=1)


def _mover(taken: np.ndarray | None, ways: np.ndarray):
    """The state with the last step settled, taken or not by ``taken[fit, lane]`` (None: there was none), and the next one tried.

    ``to`` is where the fit's coefficients ``ways[fit, vector, lane]`` lead from ``u``; ``x`` is that unscaled.
    """
    lanes = ways.shape[2]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, past, u, g, to, h = (_array(batch, c, lanes) for c in ("root", "past", "u", "g", "to", "h"))
            fit = batch["_fit"].to_numpy()
            if taken is not None:
                yes = taken[fit]
                past = _remembered(past, (to - u)[:, 0], (h - g)[:, 0], yes)
                u, g = np.where(yes[:, None], to, u), np.where(yes[:, None], h, g)
            to = u[:, 0] + (np.concatenate([past, g], axis=1) * ways[fit]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch["_fit"], batch["subject"], batch["root"], *map(_lists, (past, u, g, to, to / root[:, 0]))],
                                             ["_fit", "subject", "root", "past", "u", "g", "to", "x"])
    return run


#: Partial sums that a task holds before it hands them on.
HELD = 50_000


def _by_subject(fit: np.ndarray, subject: pa.Array, values: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``values`` (a row each) summed by fit and subject."""
    names = subject.dictionary_encode()
    codes = fit.astype(np.int64) * (len(names.dictionary) + 1) + names.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.diff(codes[order], prepend=-1))
    at = order[first]
    return fit[at], subject.take(pa.array(at)), np.add.reduceat(values[order], first, axis=0)


def _pulled(signs: list[float], before: np.ndarray, side_terms: np.ndarray):
    """Rounds beside their seats' strengths to pulls, summed by subject in the task; a fit's loss and side pull have no subject."""
    fits, lanes = side_terms.shape

    def rows(kind: str, fit: np.ndarray, subject: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fit, pa.int32()), pa.array([kind] * len(fit), pa.string()), subject, _lists(values)], ["_fit", "kind", "subject", "values"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = {"loss": np.zeros((fits, lanes)), "side": np.zeros((fits, lanes))}
        parts: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        gathered = lambda: _by_subject(np.concatenate([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
        for batch in batches:
            if not batch.num_rows:
                continue
            fit, score, side, period = (batch[c].to_numpy(zero_copy_only=False) for c in ("_fit", "score", "side", "period"))
            counts = (period[:, None] < before).astype(float)
            z = side[:, None] * side_terms[fit]
            for j, sign in enumerate(signs):
                z += sign * _array(batch, f"x{j}", lanes)[:, 0]
            off = counts * (1 / (1 + np.exp(-z)) - score[:, None])
            np.add.at(whole["loss"], fit, counts * (np.maximum(z, 0) - z * score[:, None] + np.log1p(np.exp(-np.abs(z)))))
            np.add.at(whole["side"], fit, off * side[:, None])
            for j, sign in enumerate(signs):
                seated = np.flatnonzero(batch[f"id{j}"].is_valid().to_numpy(zero_copy_only=False))
                if len(seated):
                    parts.append(_by_subject(fit[seated], batch[f"id{j}"].take(pa.array(seated)), sign * off[seated]))
            if sum(len(p[0]) for p in parts) > HELD:
                parts = [gathered()]
                if len(parts[0][0]) > HELD // 2:
                    yield rows("subject", *parts.pop())
        if parts:
            yield rows("subject", *gathered())
        for kind, values in whole.items():
            yield rows(kind, np.arange(fits), pa.nulls(fits, pa.string()), values)
    return run


_AFTER = "kind string, " + _STATE + ", sums array<double>"


def _settled(penalties: np.ndarray, fits: int, kept: int):
    """Summed pulls beside the points tried, to the state there (with scaled gradients ``h``) and a task's sums for each fit.

    The sums of a lane: the dot products of s1..sk, y1..yk, the new s and y, g and h; then, lane by lane, the squares of strengths,
    the losses and the side's pulls.
    """
    lanes, size, names = len(penalties), 2 * kept + 4, ("root", "past", "u", "g", "to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, more = np.zeros((fits, lanes, size, size)), np.zeros((3, fits, lanes))
        out = lambda kind, fit, subject, arrays, sums: pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(fit), pa.string()), pa.array(fit, pa.int32()), subject, *arrays, sums], ["kind", "_fit", "subject", *names, "h", "sums"])
        lists = pa.list_(pa.float64())
        for batch in batches:
            kinds = batch["kind"].to_numpy(zero_copy_only=False)
            for k, kind in enumerate(("loss", "side"), 1):
                own = batch.take(pa.array(np.flatnonzero(kinds == kind)))
                if own.num_rows:
                    np.add.at(more[k], own["_fit"].to_numpy(), _array(own, "pull", lanes)[:, 0])
            batch = batch.take(pa.array(np.flatnonzero(kinds == "subject")))
            if not batch.num_rows:
                continue
            fit = batch["_fit"].to_numpy()
            root, past, u, g, to, x, pull = (_array(batch, c, lanes) for c in (*names, "x", "pull"))
            h = (pull + penalties * x) / root
            vectors = np.concatenate([past, to - u, h - g, g, h], axis=1)
            for k in np.unique(fit):
                mine = vectors[fit == k]
                total[k] += np.einsum("nil,njl->lij", mine, mine)
            np.add.at(more[0], fit, x[:, 0] ** 2)
            yield out("subject", fit, batch["subject"], [*[batch[c] for c in names], _lists(h)], pa.nulls(len(fit), lists))
        yield out("sums", np.arange(fits), pa.nulls(fits, pa.string()), [pa.nulls(fits, lists)] * 6,
                  _lists(np.concatenate([total.reshape(fits, -1), *more], axis=1)))
    return run


def fit_lanes(rounds: DataFrame, scope: list[str], lanes: list[Lane], iterations: int = ITERATIONS, gradient: float = GRADIENT) -> tuple[DataFrame, DataFrame]:
    """(strengths: scope lane subject strength; fits: scope lane side_term loss iterations).

    rounds: scope section_id score side side_a_ids side_b_ids, and period_seq where a lane has ``before``. A lane without
    rounds ends at zero. There is one fit for each value of ``scope`` and lane; values of ``scope`` are few (seasons).
    """
    spark, width = rounds.sparkSession, len(lanes)
    values = sorted((tuple(r) for r in rounds.select(*scope).distinct().collect()), key=repr)
    types = ", ".join(f"`{c}` {rounds.schema[c].dataType.simpleString()}" for c in scope)
    numbers = spark.createDataFrame([(*v, k) for k, v in enumerate(values)], f"{types}, _fit int")
    penalties, fits = np.array([lane.penalty for lane in lanes], float), len(values)
    ends = np.array([math.inf if lane.before is None else lane.before for lane in lanes], float)
    period = F.col("period_seq") if np.isfinite(ends).any() else F.lit(0)
    widest = rounds.agg(*[F.max(F.size(c)).alias(c) for c in ("side_a_ids", "side_b_ids")]).first()
    seats = [(c, i, sign) for c, sign in (("side_a_ids", 1.0), ("side_b_ids", -1.0)) for i in range(widest[c] or 0)]
    base = cut_lineage(rounds.join(F.broadcast(numbers), scope).select(
        "_fit", "score", "side", *[F.get(c, F.lit(i)).alias(f"id{j}") for j, (c, i, _) in enumerate(seats)], period.cast("double").alias("period"),
        ((F.size("side_a_ids") + F.size("side_b_ids")) / 4).alias("share")))
    each = lambda make: [make(k) for k in range(width)]
    counted = [F.when(F.col("period") < float(end), 1.0).otherwise(0.0) if math.isfinite(end) else F.lit(1.0) for end in ends]
    links = base.select("_fit", "period", "share", F.explode(F.array(*[F.col(f"id{j}") for j in range(len(seats))] or [F.lit(None).cast("string")])).alias("subject"))
    start = links.where(F.col("subject").isNotNull()).groupBy("_fit", "subject").agg(*each(lambda k: F.sum(counted[k] * F.col("share")).alias(f"n{k}")))
    zeros = F.array(*[F.lit(0.0)] * width)
    state = cut_lineage(start.select(
        "_fit", "subject", F.array(*each(lambda k: F.sqrt(F.lit(lanes[k].penalty) + F.col(f"n{k}")))).alias("root"), F.array().cast("array<double>").alias("past"),
        *[zeros.alias(c) for c in ("u", "g", "to", "h")]))
    sent = F.broadcast if state.count() * (8 * width + 100) <= BROADCAST else lambda df: df
    played = base.groupBy("_fit").agg(*each(lambda k: F.sum(counted[k]).alias(f"n{k}"))).collect()
    side_root = np.ones((fits, width))
    for row in played:
        side_root[row._fit] = [math.sqrt(max(row[f"n{k}"], 4.0) / 4) for k in range(width)]

    def tried(before: DataFrame, taken: np.ndarray | None, ways: np.ndarray, side: np.ndarray, kept: int):
        """The state with a step tried, the losses and side gradients (scaled) there, and the dot products; ``kept`` pairs are remembered in it."""
        moved = before.mapInArrow(_mover(taken, ways), _MOVED)
        at = base.drop("share")
        for j in range(len(seats)):
            at = at.join(sent(moved.select("_fit", F.col("subject").alias(f"id{j}"), F.col("x").alias(f"x{j}"))), ["_fit", f"id{j}"], "left")
        at = at.select("_fit", "score", "side", "period", *[F.col(f"id{j}") for j in range(len(seats))], *[F.coalesce(f"x{j}", zeros).alias(f"x{j}") for j in range(len(seats))])
        # To a seat's subject goes its pull; to the fit as a whole the loss and the side's pull.
        pulls = (at.mapInArrow(_pulled([sign for _, _, sign in seats], ends, side), "_fit int, kind string, subject string, values array<double>")
                 .groupBy("_fit", "kind", "subject").agg(*each(lambda k: F.sum(F.col("values")[k]).alias(f"p{k}")))
                 .select("_fit", "kind", "subject", F.array(*each(lambda k: F.col(f"p{k}"))).alias("pull")))
        after = cut_lineage(pulls.join(moved, ["_fit", "subject"], "left").mapInArrow(_settled(penalties, fits, kept), _AFTER))
        size = 2 * kept + 4
        flat = np.zeros((fits, width * size * size + 3 * width))
        sums = after.where("kind = 'sums'").select("_fit", F.posexplode("sums").alias("slot", "value")).groupBy("_fit", "slot").agg(F.sum("value").alias("value"))
        for row in sums.collect():  # a few dozen numbers a lane
            flat[row._fit, row.slot] = row.value
        dots, more = flat[:, :-3 * width].reshape(fits, width, size, size), flat[:, -3 * width:].reshape(fits, 3, width)
        return after.where("kind = 'subject'").drop("kind", "sums"), more[:, 1] + penalties * more[:, 0] / 2, more[:, 2] / side_root, dots

    # The side term moves with the rest; its few vectors are kept here, scaled like the others. A lane whose step is too
    # long stays and tries half of it in the next pass, while the others go on.
    side, past = np.zeros((fits, width)), np.zeros((fits, 0, width))
    state, loss, g, products = tried(state, None, np.zeros((fits, 1, width)), side, 0)
    state, dots = state.withColumn("g", F.col("h")), products[:, :, -1:, -1:] + (g * g)[:, :, None, None]
    running, fresh, scale = np.ones((fits, width), bool), np.ones((fits, width), bool), np.ones((fits, width))
    steps, halved, fall = np.zeros((fits, width), int), np.zeros((fits, width), int), np.zeros((fits, width))
    ways, kept, taken = np.zeros((fits, 1, width)), 0, None
    for _ in range(iterations):
        running &= (dots[:, :, -1, -1] > gradient ** 2) & (halved < HALVINGS)
        if not running.any():
            break
        for f, k in zip(*np.nonzero(running & fresh)):
            ways[f, :, k] = _direction(dots[f, k], kept)
            fall[f, k] = ways[f, :, k] @ dots[f, k][:, -1]
        scaled = ways * np.where(running, scale, 0.0)[:, None]
        to = side + (np.concatenate([past, g[:, None]], axis=1) * scaled).sum(axis=1)
        state, now, h, products = tried(state, taken, scaled, to / side_root, kept)
        own = np.concatenate([past, (to - side)[:, None], (h - g)[:, None], g[:, None], h[:, None]], axis=1)
        products = products + np.einsum("fil,fjl->flij", own, own)
        taken = running & (now <= loss + 1e-4 * scale * fall + 1e-12 * np.abs(loss))
        grown = min(kept + 1, MEMORY)
        # What is remembered next: of a lane that took its step the new pair too, of another an empty pair before its own.
        pairs = lambda first, new: [*range(first, first + kept), new][-MEMORY:]
        taken_at = [*pairs(0, 2 * kept), *pairs(kept, 2 * kept + 1), 2 * kept + 3]
        empty = products.shape[2]
        wide = np.pad(products, ((0, 0), (0, 0), (0, 1), (0, 1)))
        room = [empty] if kept < MEMORY else []
        stayed_at = [*room, *range(kept), *room, *range(kept, 2 * kept), 2 * kept + 2]
        dots = np.where(taken[:, :, None, None], wide[:, :, taken_at][:, :, :, taken_at], wide[:, :, stayed_at][:, :, :, stayed_at])
        again = np.zeros((fits, 2 * grown + 1, width))
        again[:, [k for k, v in enumerate(stayed_at) if v != empty]] = ways
        past = _remembered(past, to - side, h - g, taken)
        ways, kept = again, grown
        side, g, loss = np.where(taken, to, side), np.where(taken, h, g), np.where(taken, now, loss)
        steps += taken
        halved = np.where(taken, 0, halved + running)
        scale = np.where(taken, 1.0, scale / 2)
        fresh = taken
    if taken is not None:  # the last step tried, where it was taken
        yes = spark.createDataFrame(pa.table([pa.array(range(fits), pa.int32()), _lists(taken.astype(float))], ["_fit", "yes"]))
        state = state.join(F.broadcast(yes), "_fit").withColumn("u", F.expr("transform(u, (v, i) -> if(yes[i] > 0, to[i], v))"))
    side = side / side_root
    names = F.array(*[F.lit(lane.name) for lane in lanes])
    spread = F.posexplode(F.zip_with("u", "root", lambda u, r: u / r))
    strengths = state.join(F.broadcast(numbers), "_fit").select(*scope, "subject", spread.alias("_k", "strength")).select(
        *scope, F.element_at(names, F.col("_k") + 1).alias("lane"), "subject", "strength")
    found = spark.createDataFrame([(*v, k, float(side[f, k]), float(loss[f, k]), int(steps[f, k])) for f, v in enumerate(values) for k in range(width)],
                                  f"{types}, _k int, side_term double, loss double, iterations int")
    return strengths, found.select(*scope, F.element_at(names, F.col("_k") + 1).alias("lane"), "side_term", "loss", "iterations")


def fit_bradley_terry(rounds: DataFrame, scope: list[str], penalty: float = LAMBDA, iterations: int = ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """(strengths: scope subject strength; fits: scope side_term loss iterations), over all rounds of each scope."""
    strengths, fits = fit_lanes(rounds, scope, [Lane(0, float(penalty))], iterations)
    return strengths.drop("lane"), fits.drop("lane")


def bt_log_odds(rounds: DataFrame, strengths: DataFrame, fits: DataFrame, scope: list[str]) -> DataFrame:
    """Adds ``log_odds`` of side a; a subject the fit never saw counts zero."""
    keys = [*scope, "section_id"]
    z = (_members(rounds, keys).join(strengths, [*scope, "subject"], "left")
         .groupBy(*keys).agg(F.sum(F.col("sign") * F.coalesce("strength", F.lit(0.0))).alias("_z")))
    return (rounds.join(z, keys).join(fits.select(*scope, "side_term"), scope, "left")
            .withColumn("log_odds", F.col("_z") + F.coalesce("side_term", F.lit(0.0)) * F.col("side"))
            .drop("_z", "side_term"))


def bt_to_rating(strength: Column | str) -> Column:
    return 1500 + (F.col(strength) if isinstance(strength, str) else strength) * 400 / math.log(10)
