"""Best-fit packing of token pieces by bin completion.

Lengths are whole numbers up to the capacity, so the corpus is a histogram of at most ``capacity``
counts, however many pieces there are. The driver plans on that histogram by branch and bound: best fit
decreasing of the whole histogram is the first incumbent, so no plan is worse; a branch fills the bin of
the largest remaining length (with least waste, or with the largest lengths) as often as the counts
allow, ends when a lower bound says that it can't beat the incumbent, and the last pieces are solved one
by one. The search ends at the bound, after ``BRANCH_NODES`` fillings beyond its first descent, or when
``PLAN_STEPS`` are spent, so a plan above the bound needn't be the best one.
Tasks then look up each piece's bin from its rank among equal lengths.

Ranks are counted within tasks and shifted by the counts of the tasks before, so a length that a
third of all pieces share isn't gathered anywhere.

Defined cases: a null or empty text is one piece, its end id; only documents longer than the capacity
are cut; a null doc_id and repeated rows are packed like any others, each row by itself; a very long
text is encoded whole and cut into as many pieces as it takes; equal lengths are interchangeable, so ties
between them don't matter, and of plans with as few sequences the first found stands; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import store, tokens
from sievework.llm import textkit as K

CAPACITY = 4096
#: Steps that the search for one bin's completion, and that for the last bins, may take.
COMPLETION_STEPS, TAIL_STEPS = 4000, 60_000
#: Steps of all such searches of a plan together, which bounds the time that the driver plans for.
PLAN_STEPS = 800_000
#: Fillings that are weighed for each of the last bins.
WIDTH = 200
#: Fillings that are tried after the first descent.
BRANCH_NODES = 500
#: The last pieces, at most, that are solved by branch and bound.
TAIL_PIECES = 48

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class Steps:
    """What is left of the steps of a plan."""

    def __init__(self, left: int = PLAN_STEPS):
        self.left = left

    def grant(self, wanted: int) -> int:
        """At most ``wanted`` steps; what isn't used comes back by ``back``."""
        given = min(wanted, self.left)
        self.left -= given
        return given

    def back(self, unused: int) -> None:
        self.left += max(unused, 0)


class Histogram:
    """Counts of the remaining lengths, with the largest length up to a bound."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v > 0}
        self.order = np.array(sorted(self.counts), np.int64)

    def up_to(self, bound: int) -> list[int]:
        """Remaining lengths of at most ``bound``, largest first."""
        return self.order[: np.searchsorted(self.order, bound, "right")][::-1].tolist()

    def take(self, filling: dict[int, int], times: int) -> None:
        for length, n in filling.items():
            self.counts[length] -= n * times
            if not self.counts[length]:
                del self.counts[length]
                self.order = np.delete(self.order, np.searchsorted(self.order, length))

    def put(self, filling: dict[int, int], times: int) -> None:
        """Undo ``take``."""
        for length, n in filling.items():
            if length not in self.counts:
                self.order = np.insert(self.order, np.searchsorted(self.order, length), length)
            self.counts[length] = self.counts.get(length, 0) + n * times


def completion(left: Histogram, room: int, first: int, budget: Steps) -> dict[int, int]:
    """Lengths that fill ``room`` beside ``first`` with the least waste that the search finds.

    Larger lengths are tried first, so a filling dominated by one that holds a single length in place
    of several of the same sum isn't reached before it. A branch ends when even a full use of what is
    left of the room can't lower the waste.
    """
    best: tuple[int, dict[int, int]] = (room, {})
    steps = budget.grant(COMPLETION_STEPS)
    spare = dict(left.counts)
    spare[first] -= 1
    order = left.order

    def fill(room: int, top: int, chosen: dict[int, int]) -> bool:
        nonlocal best, steps
        if room < best[0]:
            best = (room, dict(chosen))
            if not room:
                return True
        at = min(int(np.searchsorted(order, room, "right")), top) - 1
        while at >= 0 and steps > 0:
            length = int(order[at])
            for n in range(min(spare[length], room // length), 0, -1):
                steps -= 1
                if fill(room - n * length, at, chosen | {length: n}):
                    return True
                if steps <= 0:
                    break
            at -= 1
        return False

    fill(room, len(order), {})
    budget.back(steps)
    return best[1]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: each length into the fullest bin that holds it."""
    bins: list[list[int]] = []
    rooms: list[int] = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            i = min(fits, key=rooms.__getitem__)
            bins[i].append(length)
            rooms[i] -= length
        else:
            bins.append([length])
            rooms.append(capacity - length)
    return bins


def solve_tail(lengths: list[int], capacity: int, budget: Steps | None = None) -> list[list[int]]:
    """Few pieces in as few bins as branch and bound finds within its steps."""
    incumbent = best_fit(lengths, capacity)
    least = -(-sum(lengths) // capacity)
    budget = budget or Steps(TAIL_STEPS)
    steps = budget.grant(TAIL_STEPS)

    def fillings(items: list[int], room: int) -> Iterator[list[int]]:
        """Fillings of ``room`` from ``items`` (largest first), none of which holds another's rest."""
        nonlocal steps
        tried: set[int] = set()
        for i, length in enumerate(items):
            if length <= room and length not in tried and steps > 0:
                steps -= 1
                tried.add(length)
                for rest in fillings(items[i + 1 :], room - length):
                    yield [length, *rest]
        if not tried:
            yield []

    def descend(items: list[int], done: list[list[int]], waste: int) -> None:
        nonlocal incumbent
        if not items:
            if len(done) < len(incumbent):
                incumbent = [list(b) for b in done]
            return
        if steps <= 0 or len(incumbent) == least:
            return
        if len(done) + -(-sum(items) // capacity) >= len(incumbent):
            return  # the waste so far leaves no way below the incumbent
        largest, rest = items[0], items[1:]
        found = sorted(itertools.islice(fillings(rest, capacity - largest), WIDTH), key=lambda f: -sum(f))
        for filling in found:
            after = list(rest)
            for x in filling:
                after.remove(x)
            descend(after, [*done, [largest, *filling]], waste + capacity - largest - sum(filling))

    descend(sorted(lengths, reverse=True), [], 0)
    budget.back(steps)
    return incumbent


def best_fit_fillings(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing of the whole histogram, as (filling, times): equal bins are filled together."""
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: dict[int, int], times: int) -> None:
        if room not in bins:
            bisect.insort(rooms, room)
        bins.setdefault(room, []).append((filling, times))

    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        n = counts[length]
        # The fullest bin that holds a piece takes as many as fit, being the fullest still.
        at = bisect.bisect_left(rooms, length)
        moved = []
        while n and at < len(rooms):
            room = rooms.pop(at)
            for filling, times in bins.pop(room):
                each = room // length
                whole = min(times, n // each)
                n -= whole * each
                over = n if whole < times else 0
                n -= over
                moved += [(room - each * length, filling | {length: each}, whole)] if whole else []
                moved += [(room - over * length, filling | {length: over}, 1)] if over else []
                moved += [(room, filling, times - whole - bool(over))] if times - whole - bool(over) else []
        each = capacity // length
        moved += [(capacity - each * length, {length: each}, n // each)] if n // each else []
        moved += [(capacity - n % each * length, {length: n % each}, 1)] if n % each else []
        for row in moved:
            put(*row)
    return [row for room in rooms for row in bins[room]]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: by the sum, and by the pieces of which at most k fit a bin."""
    lengths = np.array(list(counts), np.int64)
    n = np.array(list(counts.values()), np.int64)
    return max([-(-int((lengths * n).sum()) // capacity), *(-(-int(n[lengths * (k + 1) > capacity].sum()) // k) for k in range(1, 9))])


def fillings(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """All pieces as (filling, times), by branch and bound on the histogram with best fit decreasing as the
    first incumbent. A branch fills the bin of the largest length, as often as the counts allow."""
    best = best_fit_fillings(counts, capacity)
    n_best, least = sum(t for _, t in best), least_bins(counts, capacity)
    left, remaining = Histogram(counts), sum(counts.values())
    done: list[tuple[dict[int, int], int]] = []
    others: list[list[tuple[dict[int, int], int]]] = []
    n_done, nodes, reached, budget = 0, BRANCH_NODES, False, Steps()

    def choices() -> list[tuple[dict[int, int], int]]:
        """The filling of least waste; the one of largest lengths; the first for half the bins."""
        largest = int(left.order[-1])
        tight = completion(left, capacity - largest, largest, budget) if largest < capacity else {}
        tight[largest] = tight.get(largest, 0) + 1
        wide, room = {largest: 1}, capacity - largest
        for length in left.up_to(room):
            if length <= room:
                n = min(left.counts[length] - wide.get(length, 0), room // length)
                if n > 0:
                    wide[length] = wide.get(length, 0) + n
                    room -= n * length
        times = min(left.counts[k] // n for k, n in tight.items())
        found = [(tight, times)]
        if wide != tight:
            found.append((wide, min(left.counts[k] // n for k, n in wide.items())))
        return found + ([(tight, times // 2)] if times > 1 else [])

    while n_best > least:
        if remaining <= TAIL_PIECES and n_done + least_bins(left.counts, capacity) < n_best:
            tail = solve_tail([k for k, n in left.counts.items() for _ in range(n)], capacity, budget)
            if n_done + len(tail) < n_best:
                best, n_best = [*done, *((dict(Counter(b)), 1) for b in tail)], n_done + len(tail)
            reached, ways = True, []
        elif n_done + least_bins(left.counts, capacity) >= n_best:
            reached, ways = True, []  # no way below the incumbent
        else:
            ways = choices()
        while not ways and done:
            filling, times = done.pop()
            left.put(filling, times)
            n_done -= times
            remaining += times * sum(filling.values())
            ways = others.pop()
        nodes -= reached  # the first descent is free
        if not ways or nodes < 0 or not budget.left:
            break
        filling, times = ways.pop(0)
        left.take(filling, times)
        n_done += times
        remaining -= times * sum(filling.values())
        done.append((filling, times))
        others.append(ways)
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of slots: pieces of ``length`` with ranks from ``rank`` on lie ``each`` to a bin, the first
    in bin ``bin`` at ``offset``; ordered by (length, rank)."""
    used: dict[int, int] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    n_bins = 0
    for filling, times in fillings({k: n for k, n in counts.items() if n > 0}, capacity):
        offset = 0
        for length, each in sorted(filling.items(), reverse=True):
            rows.append((length, used.get(length, 0), n_bins, each, offset))
            used[length] = used.get(length, 0) + each * times
            offset += length * each
        n_bins += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "bin", "each", "offset"), columns, strict=True)) | {"n_bins": n_bins}


def locate(runs: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces by length and rank among equal lengths."""
    width = 1 << 48
    at = np.searchsorted(runs["length"] * width + runs["rank"], length * width + rank, "right") - 1
    over = rank - runs["rank"][at]
    each = runs["each"][at]
    return runs["bin"][at] + over // each, runs["offset"][at] + over % each * length


def _pieces_kernel(path: str, end: int, capacity: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, ids, bounds in tokens.encoded_blocks(batches, path, end):
            n_pieces = -(-np.diff(bounds) // capacity)
            doc = np.repeat(np.arange(len(n_pieces)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            a = bounds[doc] + start
            b = np.minimum(a + capacity, bounds[doc + 1])
            length = b - a
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            nth = np.empty(len(doc), np.int64)
            nth[order] = seen[ordered] + np.arange(len(doc)) - first
            seen += np.bincount(length, minlength=capacity + 1)
            crcs = [tokens.crc32(ids[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield K.table(doc_id=rows.column("doc_id").take(pa.array(doc)), piece=piece.astype(np.int32), start=start, length=length, ids_crc32=pa.array(crcs, pa.int64()), part=np.full(len(doc), part, np.int32), nth=nth)

    return kernel


def cut_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids with their task's number and rank among equal lengths in it."""
    pieces = K.map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _pieces_kernel(tokenizer, end, capacity), PIECES)
    return store.written(pieces, "pieces")  # once: parts and ranks must not change


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # At most ``capacity`` rows reach the driver.
    counts = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    ranked = pieces.join(shift, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("shift")).alias("rank"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = locate(runs, length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return K.map_blocks(ranked, kernel, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
