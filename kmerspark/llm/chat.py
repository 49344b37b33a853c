"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prefix_sums, range_partitioned, read_table, sliced

#: States are named by the last turn written. A conversation is legal as [system] (user assistant)+, or empty.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Role names read as one of the three; any other, or null, may become each of them at the low cost.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
UNKNOWN = 0
#: Costs of one repair.
INSERT, RELABEL, RELABEL_UNKNOWN, MERGE_SAME, MERGE_UNKNOWN, MERGE_OTHER, MERGE_BLANK = 4, 6, 1, 2, 3, 7, 1
FAR = 1 << 40
#: Bytes of a conversation that are repaired in one piece of memory, each turn counting TURN_BYTES besides its text; longer ones are cut into parts.
PART_BYTES, TURN_BYTES = 4_000_000, 100
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _inserted(start: int) -> list[tuple[int, tuple[int, ...]]]:
    """States reached by writing up to two empty turns, with those turns."""
    out = [(start, ())]
    for s in NEXT[start]:
        out.append((s, (s,)))
        out += [(t, (s, t)) for t in NEXT[s]]
    return out


@lru_cache
def moves(role: int, blank: bool) -> dict[tuple[int, int], tuple]:
    """Cheapest way to take a turn from one state to another: (cost, empty turns written before it, kind, role)."""
    best: dict[tuple[int, int], tuple] = {}
    for s in range(4):
        ways = []
        for t, empties in _inserted(s):
            for r in NEXT[t]:
                change = 0 if r == role else RELABEL_UNKNOWN if role == UNKNOWN else RELABEL
                ways.append((INSERT * len(empties) + change, len(empties), "keep" if r == role else "relabel", r, empties))
        if s != START:
            cost = MERGE_BLANK if blank else MERGE_SAME if s == role else MERGE_UNKNOWN if role == UNKNOWN else MERGE_OTHER
            ways.append((cost, 0, "merge", s, ()))
        for cost, n, kind, r, empties in sorted(ways):
            if (s, r) not in best:
                best[s, r] = (cost, empties, kind)
    return best


@lru_cache
def matrix(role: int, blank: bool) -> np.ndarray:
    m = np.full((4, 4), FAR, np.int64)
    for (s, t), way in moves(role, blank).items():
        m[s, t] = way[0]
    return m


#: Cost of ending in a state, by the empty turns that make it legal.
ENDINGS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
END_COST = np.array([INSERT * len(ENDINGS[s]) for s in range(4)], np.int64)


def product(codes: list[tuple[int, bool]]) -> np.ndarray:
    """Min-plus product of the turns' matrices: the cheapest cost from any state to any state."""
    out = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(out, 0)
    for c in codes:
        out = np.minimum((out[:, :, None] + matrix(*c)[None]).min(axis=1), FAR)
    return out


def repair(codes: list[tuple[int, bool]], entry: int = START, ahead: tuple[int, ...] = tuple(END_COST.tolist())) -> tuple[int, list[tuple]]:
    """Cheapest path over the turns from ``entry``, where ending in a state costs ``ahead``: (cost, [(state, empties, kind)]).

    Of equal costs the path through the lower states, seen from the start, is taken, so the path over a part of a
    conversation is that part of the whole's path if ``ahead`` are the least costs of what follows.
    """
    to_go = [list(ahead)]
    for c in reversed(codes):
        after, before = to_go[-1], [FAR] * 4
        for (s, t), way in moves(*c).items():
            before[s] = min(before[s], way[0] + after[t])
        to_go.append(before)
    to_go.reverse()
    s, path = entry, []
    for i, c in enumerate(codes):
        ways = moves(*c)
        t = next(t for t in range(4) if (s, t) in ways and ways[s, t][0] + to_go[i + 1][t] == to_go[i][s])
        path.append((t, ways[s, t][1], ways[s, t][2]))
        s = t
    return to_go[0][entry], path


def render(texts: list[str], path: list[tuple], entry: int = START, ends: bool = True) -> str:
    """The repaired turns as text. Marks inside of a turn's text are broken up so that they cannot pose as turns."""
    out, state = [], entry
    for text, (t, empties, kind) in zip(texts, path, strict=True):
        text = (text or "").replace("<|im_", "<| im_")
        if kind == "merge":
            out.append(f"\n{text}" if text else "")
        else:
            out.append(f"{CLOSE}\n" if state != START else "")
            out += [f"{OPEN}{ROLES[r]}\n{CLOSE}\n" for r in empties]
            out.append(f"{OPEN}{ROLES[t]}\n{text}")
        state = t
    if ends and state != START:
        out.append(f"{CLOSE}\n")
        out += [f"{OPEN}{ROLES[r]}\n{CLOSE}\n" for r in ENDINGS[state]]
    return "".join(out)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns."""
    held, rows = None, []
    for b in sliced(batches):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != held:
                if rows:
                    yield held, rows
                held, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield held, rows


SCHEMA = "conv_id long, part long, n_turns long, n_out long, n_merged long, n_relabelled long, n_inserted long, cost long, rendered string"


def _coded(r: str | None, t: str | None) -> tuple[int, bool]:
    return ALIASES.get((r or "").strip().lower(), UNKNOWN), not (t or "").strip()


def _joints(rows: DataFrame, n: int) -> DataFrame:
    """(conv, part, number, last, entry, ahead) of every part of the conversations of several parts.

    Parts' matrices are chained from the end to the least costs that follow each part; with these, a part's way from each state it
    may be entered in is fixed, and the ways are chained from the start.
    """
    rows = rows.select("conv", "part", "row", "role", "text")
    pieces = lambda df: df.repartition(n, "conv", "part").sortWithinPartitions("conv", "part", "row")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, p), some in _groups(batches, 2):
            m = product([_coded(x[3], x[4]) for x in some]).ravel().tolist()
            yield pa.RecordBatch.from_pydict({"conv": pa.array([c], pa.int64()), "part": pa.array([p], pa.int64()), "m": pa.array([m], pa.list_(pa.int64()))})

    def costs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        ahead = [END_COST]
        for m in pdf["m"].iloc[:0:-1]:
            ahead.append(np.minimum((np.array(m, np.int64).reshape(4, 4) + ahead[-1][None]).min(axis=1), FAR))
        return pd.DataFrame({"conv": pdf["conv"], "part": pdf["part"], "ahead": [x.tolist() for x in ahead[::-1]]})

    costed = pieces(rows).mapInArrow(products, "conv long, part long, m array<long>").groupBy("conv").applyInPandas(costs, "conv long, part long, ahead array<long>")
    costed = materialize(costed, "chat-costs")
    both = rows.alias("r").join(costed.alias("a"), F.col("r.conv").eqNullSafe(F.col("a.conv")) & (F.col("r.part") == F.col("a.part"))).select("r.*", "a.ahead")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, p), some in _groups(batches, 2):
            codes, ahead = [_coded(x[3], x[4]) for x in some], tuple(some[0][5])
            leave = [repair(codes, s, ahead)[1][-1][0] if matrix(*codes[0])[s].min() < FAR else s for s in range(4)]
            yield pa.RecordBatch.from_pydict({"conv": pa.array([c], pa.int64()), "part": pa.array([p], pa.int64()), "ahead": pa.array([ahead], pa.list_(pa.int64())), "leave": pa.array([leave], pa.list_(pa.int32()))})

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        entry = [START]
        for leave in pdf["leave"]:
            entry.append(int(leave[entry[-1]]))
        number = list(range(len(pdf)))
        return pd.DataFrame({"conv": pdf["conv"], "part": pdf["part"], "number": number, "last": [i == len(pdf) - 1 for i in number], "entry": entry[:-1], "ahead": pdf["ahead"]})

    walked = pieces(both).mapInArrow(ways, "conv long, part long, ahead array<long>, leave array<int>")
    return materialize(walked.groupBy("conv").applyInPandas(entries, "conv long, part long, number long, last boolean, entry int, ahead array<long>"), "chat-joints")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Repair every conversation at the least cost and render it.

    Dynamic programming over the automaton picks, for each turn, to keep it, relabel it, merge it into the turn before,
    or write empty turns before it. The cost of a turn only depends on its role and on its being blank, so a stretch
    of turns is a 4 x 4 min-plus matrix: conversations of over ``part_bytes`` are cut into parts, the parts'
    matrices are chained to fix the states between them, and the parts are repaired apart. The repair is the one of the whole
    conversation, however it is cut. There is a row per conversation and part, numbered from 0; rows of a conversation, in order,
    concatenate to the whole text, and their counts and costs add up to the whole's.

    Turns are ordered by ``turn`` (nulls first), ties by role, then text. Null texts count as blank, null or unknown
    roles may become any role, a null conversation id is one conversation; repeated rows are repeated turns; an empty
    table gives an empty result; a very long turn is a part of its own; other columns are ignored, whatever their names.
    """
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    slim = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    cut = range_partitioned(slim, order, "chat-cut")
    rows = prefix_sums(cut, {"row": F.lit(1), "at": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + TURN_BYTES}, order).drop("_pid")
    first = rows.groupBy("conv").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    rows = rows.alias("r").join(first.alias("f"), F.col("r.conv").eqNullSafe(F.col("f.conv"))).select("r.*", "f.first", "f.last")
    rows = rows.withColumn("part", F.expr(f"(at - first) div {part_bytes}")).withColumn("several", F.expr(f"(last - first) div {part_bytes} > 0"))
    rows = materialize(rows.select("conv", "part", "row", "role", "text", "several"), "chat-parts")
    whole = rows.filter("NOT several").select("conv", "part", "row", "role", "text", F.lit(0).cast("long").alias("number"), F.lit(True).alias("last"), F.lit(START).alias("entry"), F.array(*[F.lit(int(c)).cast("long") for c in END_COST]).alias("ahead"))
    long = rows.filter("several")
    if long.limit(1).count():
        joints = _joints(long, n)
        joined = long.alias("r").join(joints.alias("j"), F.col("r.conv").eqNullSafe(F.col("j.conv")) & (F.col("r.part") == F.col("j.part")))
        whole = whole.unionByName(joined.select("r.conv", "r.part", "r.row", "r.role", "r.text", "j.number", "j.last", "j.entry", "j.ahead"))
    whole = whole.repartition(n, "conv", "part").sortWithinPartitions("conv", "part", "row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for (c, _), some in _groups(batches, 2):
            number, last, entry, ahead = some[0][5:]
            cost, path = repair([_coded(x[3], x[4]) for x in some], entry, tuple(ahead))
            leave = path[-1][0]
            tail = ENDINGS[leave] if last else ()
            cost -= 0 if last else ahead[leave]  # what follows is for the later parts
            empties = sum(len(x[1]) for x in path) + len(tail)
            merged = sum(x[2] == "merge" for x in path)
            out.append((c, number, len(some), len(some) - merged + empties, merged, sum(x[2] == "relabel" for x in path), empties, cost, render([x[4] for x in some], path, entry, last)))
            size += len(out[-1][-1])
            if size > 2_000_000:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return whole.mapInArrow(write, SCHEMA)


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return format_chats(read_table(spark, sf_dir, "conversations"))
