"""Repair of conversation structure by dynamic programming over a grammar.

After the damage that the contract asks for, every row of a conversation is a
symbol: it must go (blank, or its role and text were seen earlier), or it has a
role (system, user, assistant, other) and may be truncated.  The cheapest edits
that lead to the roles ``(s?(ua)+)?`` are a walk through four states: nothing
kept, after the system row, after a user row, after an assistant row.

Re-Pair compresses the symbol sequences of all conversations: the pairs are
counted over all of them in a Spark job, the most frequent ones that do not get
in each other's way become rules, and so on.  Each rule has one min-plus matrix
over the states, made of the matrices of its two parts.  An entry holds the cost,
the state in the middle (so the audit is a rope that is only unrolled where it is
needed) and the rank of its audit among the entries of its row.  Ranks settle
ties exactly: audits of one row have the same number of row edits and end with
one, so none is the beginning of another, and the first part decides.

A conversation may be of any length.  Equal rows are counted before anything
moves; the rest, without texts, is dealt out by ranges of (conversation, turn)
and cut into blocks of at most ``BLOCK`` rows, so a long conversation is spread
over many tasks.  One 4 x 4 matrix per block comes together per conversation.
Only the hash of the repaired text needs the rows of a conversation in one place:
they stream through a task, which holds a batch, the hash and the audit.

Null roles and texts count as one space, and so do nulls in the text that decides
about the damage.  Rows with a null conversation form one conversation.  Rows of
the same turn are taken in the order of their role, then of the digest of role
and text; repeated rows are duplicates.  A role of no characters has no initial
and fits nowhere.  Other columns are not looked at.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import prepare
from tarnwork.operators.keyed import lookup_join
from tarnwork.session import scratch_path

# ---- fixed values: costs of the edits and the roles in order ------------------
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL_PAIRS = ("su", "ua", "au")
# ------------------------------------------------------------------------------

#: Rows of a block; rules of the grammar; pairs that become rules in one round, and that are looked at for it.
BLOCK, RULES, ROUND, LOOKED_AT = 1024, 128, 16, 512

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: A turn of a user follows all states but the one after a user.
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
INITIALS = "sua"
#: Symbols: 0 must go; 1 to 4 system, user, assistant, other; 5 to 8 the same, truncated.
TERMINALS = 9


def damaged(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The rows with nulls as one space and the contract's damage; ``copies`` is 0 for a dropped and 2 for a repeated row."""
    space = F.lit(" ")
    conv = F.coalesce(F.col(conversation).cast("string"), space)
    turn = F.col("turn").cast("long")
    fate = F.crc32(F.concat(conv, F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    out = rows.select(
        F.col(conversation).alias("conv_id"),
        conv.alias("conv"),
        turn.alias("turn"),
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )
    return out.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


#: Ascending order puts null turns first.
ORDER = ["turn", "role", "digest"]


def faults(rows: DataFrame) -> DataFrame:
    """One row per (conv, turn, role, digest) of damaged rows: ``n`` of them, blank, truncated, and whether the first stands here."""
    solid = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    units = (
        rows.where("copies > 0")
        .withColumns({"blank": ~solid, "truncated": solid & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})
        .groupBy("conv", "turn", "role", "digest", "blank", "truncated")
        .agg(F.sum("copies").cast("long").alias("n"))
        .withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))
    )
    first = units.groupBy("conv", "digest").agg(F.min("place").alias("first"))
    marked = lookup_join(units, first, ["conv", "digest"], "inner")
    here = (F.col("place.known") == F.col("first.known")) & F.col("place.turn").eqNullSafe(F.col("first.turn"))
    return marked.select("conv", "turn", "role", "digest", "blank", "truncated", "n", here.alias("first"))


# ---- blocks --------------------------------------------------------------------

_BLOCKS = (
    "conv string, turn long, role string, digest string, part int, at int, symbols binary, blank long, duplicate long, truncated long, "
    "illegal long, first_initial string, last_initial string, least long, most long, turns long"
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted rows of a partition into blocks of one conversation."""
    from pyspark import TaskContext

    part, number, ready, now = TaskContext.get().partitionId(), 0, [], None
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    schema = pa.schema([(n, pa.string()) if k == "string" else (n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in _BLOCKS.split(", "))])

    def begun(row: dict) -> dict:
        nonlocal number
        number += 1
        zero = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        return {**{k: row[k] for k in ("conv", "turn", "role", "digest")}, "part": part, "at": number, "symbols": bytearray(), **zero, "first_initial": row["role"][:1], "last_initial": None, "least": None, "most": None}

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**{n: r[n] for n in names}, "symbols": bytes(r["symbols"])} for r in rows], schema)

    for batch in batches:
        for row in batch.to_pylist():
            initial, left, fresh = row["role"][:1], row["n"], row["first"] and not row["blank"]
            while left:
                if now is None or now["conv"] != row["conv"] or len(now["symbols"]) >= BLOCK:
                    ready += [now] if now is not None else []
                    now = begun(row)
                    if len(ready) >= 200:
                        yield packed(ready)
                        ready = []
                take = min(left, BLOCK - len(now["symbols"]))
                symbols = bytes(take)
                if fresh:
                    symbols = bytes([1 + (INITIALS.index(initial) if initial and initial in INITIALS else 3) + 4 * row["truncated"]]) + bytes(take - 1)
                if now["last_initial"] is not None:
                    now["illegal"] += now["last_initial"] + initial not in LEGAL_PAIRS
                now["illegal"] += take - 1
                now["blank"] += take * row["blank"]
                now["duplicate"] += 0 if row["blank"] else take - fresh
                now["truncated"] += fresh and row["truncated"]
                if row["turn"] is not None and row["turn"] != now["most"]:
                    now["least"] = row["turn"] if now["least"] is None else now["least"]
                    now["most"] = row["turn"]
                    now["turns"] += 1
                now["symbols"] += symbols
                now["last_initial"] = initial
                left, fresh = left - take, False
    ready += [now] if now is not None else []
    if ready:
        yield packed(ready)


# ---- grammar -------------------------------------------------------------------


def replaced(symbols: np.ndarray, rules: list[tuple[int, int, int]]) -> np.ndarray:
    """A sequence in which the pairs (left, right) of rules that do not interfere have become their symbols; -1 separates texts."""
    if len(symbols) < 2:
        return symbols
    left, right = symbols[:-1], symbols[1:]
    names = np.full(len(left), -1, np.int64)
    for a, b, name in rules:
        hit = (left == a) & (right == b)
        if a == b and hit.any():
            # In a run of equal symbols every second place begins a pair.
            at = np.flatnonzero(hit)
            begins = np.concatenate([[True], np.diff(at) > 1])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            hit[at[run % 2 == 1]] = False
        names[hit] = name
    out = symbols.copy()
    begin = np.flatnonzero(names >= 0)
    out[begin] = names[begin]
    stay = np.ones(len(symbols), bool)
    stay[begin + 1] = False
    return out[stay]


def _joined(sequences: list[bytes]) -> np.ndarray:
    """Sequences behind each other, -1 between them."""
    parts = []
    for s in sequences:
        parts += [np.frombuffer(s, np.uint8).astype(np.int64), np.array([-1])]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def compressed(sequences: list[bytes], rounds: list[list[tuple[int, int, int]]]) -> list[np.ndarray]:
    symbols = _joined(sequences)
    for rules in rounds:
        symbols = replaced(symbols, rules)
    ends = np.flatnonzero(symbols < 0)
    return [part[:-1] for part in np.split(symbols, ends + 1)[:-1]] if len(ends) else []


def pair_counts(sequences: list[bytes], weights: list[int], rounds: list[list[tuple[int, int, int]]]) -> dict[tuple[int, int], int]:
    """Weighted counts of neighbouring symbols; in a run of equal ones only pairs that do not overlap count."""
    counts: dict[tuple[int, int], int] = {}
    for symbols, weight in zip(compressed(sequences, rounds), weights, strict=True):
        previous = None
        for pair in zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True):
            if pair == previous and pair[0] == pair[1]:
                previous = None
                continue
            counts[pair] = counts.get(pair, 0) + weight
            previous = pair
    return counts


def chosen(counts: list[tuple[int, int, int]], first_name: int, most: int) -> list[tuple[int, int, int]]:
    """Rules for the most frequent pairs of which none ends with what another one begins with."""
    rules, begins, ends = [], set(), set()
    for a, b, _ in counts:
        if len(rules) == most:
            break
        if a in ends or b in begins or (a == b and a in begins):
            continue
        begins.add(a)
        ends.add(b)
        rules.append((a, b, first_name + len(rules)))
    return rules


def grammar(sequences: DataFrame, most: int = RULES) -> list[list[tuple[int, int, int]]]:
    """Rounds of (left, right, name) from distinct sequences with their counts ``n``.  The driver gets LOOKED_AT pairs a round."""
    rounds: list[list[tuple[int, int, int]]] = []
    made = 0
    while made < most:
        now = list(rounds)

        def counted(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], int] = {}
            for batch in batches:
                for pair, n in pair_counts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), now).items():
                    total[pair] = total.get(pair, 0) + n
            if total:
                left, right = zip(*total, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(total.values(), pa.int64())], names=["a", "b", "n"])

        pairs = sequences.select("symbols", "n").mapInArrow(counted, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        top = pairs.where("n >= 2").orderBy(F.desc("n"), "a", "b").limit(LOOKED_AT).collect()
        rules = chosen([(r.a, r.b, r.n) for r in top], TERMINALS + made, min(ROUND, most - made))
        if not rules:
            break
        rounds.append(rules)
        made += len(rules)
    return rounds


# ---- matrices ------------------------------------------------------------------


def terminal(symbol: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to) -> (cost, audit) of one row with the insertions before it."""
    role, extra = (symbol - 1) % 4, TRUNCATED if symbol > 4 else 0
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for begin in range(STATES):
        state, cost, audit = begin, 0, ""
        for _ in range(3):
            options = [(state, DELETE, "D")]
            if symbol:
                options.append((FOLLOWS[state], REROLE + extra, "R"))
                if role == 0 and state == START:
                    options.append((SYSTEM, KEEP + extra, "K"))
                if role in (1, 2) and FOLLOWS[state] == (USER if role == 1 else ASSISTANT):
                    options.append((FOLLOWS[state], KEEP + extra, "K"))
            for to, price, name in options:
                option = (cost + price, audit + name)
                best[begin, to] = min(best.get((begin, to), option), option)
            state, cost, audit = FOLLOWS[state], cost + INSERT, audit + "I"
    return best


class Matrix:
    """Costs, ranks of the audits within a row, and the middle states of the two parts (none for a terminal)."""

    __slots__ = ("cost", "rank", "middle")

    def __init__(self, cost, rank, middle=None):
        self.cost, self.rank, self.middle = cost, rank, middle

    @staticmethod
    def of_terminal(symbol: int) -> Matrix:
        best = terminal(symbol)
        cost = [[best.get((i, j), (NEVER, ""))[0] for j in range(STATES)] for i in range(STATES)]
        rank = [[0] * STATES for _ in range(STATES)]
        for i in range(STATES):
            for place, j in enumerate(sorted((j for j in range(STATES) if (i, j) in best), key=lambda j: best[i, j][1])):
                rank[i][j] = place
        return Matrix(cost, rank)

    @staticmethod
    def product(a: Matrix, b: Matrix) -> Matrix:
        cost, rank, middle = ([[x] * STATES for _ in range(STATES)] for x in (NEVER, 0, 0))
        for i in range(STATES):
            keys = []
            for j in range(STATES):
                options = [(a.cost[i][k] + b.cost[k][j], a.rank[i][k], k) for k in range(STATES) if a.cost[i][k] < NEVER and b.cost[k][j] < NEVER]
                if options:
                    cost[i][j], first, k = min(options)
                    middle[i][j] = k
                    keys.append((first, b.rank[k][j], j))
            for place, (_, _, j) in enumerate(sorted(keys)):
                rank[i][j] = place
        return Matrix(cost, rank, middle)


class Evaluator:
    """Matrices of all symbols of a grammar, bottom-up, and of whole sequences; unrolls audits."""

    def __init__(self, rounds: list[list[tuple[int, int, int]]]):
        self.rounds = rounds
        self.matrices = {s: Matrix.of_terminal(s) for s in range(TERMINALS)}
        self.parts: dict[int, tuple[int, int]] = {}
        for rules in rounds:
            for a, b, name in rules:
                self.parts[name] = (a, b)
                self.matrices[name] = Matrix.product(self.matrices[a], self.matrices[b])
        self.terminals = {s: {k: v[1] for k, v in terminal(s).items()} for s in range(TERMINALS)}
        self.known: dict[tuple[int, int, int], str] = {}

    def products(self, symbols: list[int]) -> list[Matrix]:
        """The matrices of all beginnings of a sequence."""
        out = [self.matrices[symbols[0]]]
        for s in symbols[1:]:
            out.append(Matrix.product(out[-1], self.matrices[s]))
        return out

    def rope(self, symbol: int, i: int, j: int) -> str:
        """The audit of a symbol from state i to state j."""
        if symbol < TERMINALS:
            return self.terminals[symbol][i, j]
        found = self.known.get((symbol, i, j))
        if found is None:
            k, (a, b) = self.matrices[symbol].middle[i][j], self.parts[symbol]
            found = self.rope(a, i, k) + self.rope(b, k, j)
            if len(found) <= 4 * BLOCK and len(self.known) < 16 * (RULES + TERMINALS):
                self.known[symbol, i, j] = found
        return found

    def audit(self, symbols: list[int], i: int, j: int) -> str:
        """The audit of a sequence from state i to state j."""
        matrices, out = self.products(symbols), []
        for at in range(len(symbols) - 1, -1, -1):
            k = matrices[at].middle[i][j] if at else i
            out.append(self.rope(symbols[at], k, j))
            j = k
        return "".join(reversed(out))


#: End state -> (cost, audit) of what must still be inserted.
TAILS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


@lru_cache(maxsize=4)
def _evaluator(rounds: tuple) -> Evaluator:
    return Evaluator([list(r) for r in rounds])


def _frozen(rounds: list[list[tuple[int, int, int]]]) -> tuple:
    return tuple(tuple(r) for r in rounds)


def _block_matrices(rounds: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = _evaluator(rounds), {}
        for batch in batches:
            sequences = batch.column(batch.schema.get_field_index("symbols")).to_pylist()
            fresh = list(dict.fromkeys(s for s in sequences if s not in known))
            if len(known) > 50_000:
                known, fresh = {}, list(dict.fromkeys(sequences))
            for s, symbols in zip(fresh, compressed(fresh, own.rounds), strict=True):
                last = own.products(symbols.tolist())[-1]
                known[s] = (sum(last.cost, []), sum(last.rank, []))
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if n != "symbols"}
            columns["costs"] = pa.array([known[s][0] for s in sequences], pa.list_(pa.int64()))
            columns["ranks"] = pa.array([known[s][1] for s in sequences], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


_ENDS = "part int, at int, begin int, end int, tail string, cost long, blank long, duplicate long, truncated long, illegal long, gaps long"


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the blocks of whole conversations: the states at the ends of each block, and the sums with the last block."""
    schema = pa.schema([(n, {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}[k]) for n, k in (x.split() for x in _ENDS.split(", "))])
    conv, blocks, sums, ready = None, [], None, []

    def closed() -> list[dict]:
        cost, _, state = min((cost + TAILS[j][0], rank, j) for j, (cost, rank) in enumerate(zip(sums["cost"], sums["rank"], strict=True)) if cost < NEVER)
        gaps = 0 if sums["least"] is None else sums["most"] - sums["least"] + 1 - sums["turns"]
        last = {"tail": TAILS[state][1], "cost": cost, "gaps": gaps, **{k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}}
        rows = []
        for part, at, before in reversed(blocks):
            rows.append({"part": part, "at": at, "begin": before[state], "end": state, **last})
            last, state = {}, before[state]
        return rows

    for batch in batches:
        for row in batch.to_pylist():
            if row["conv"] != conv or sums is None:
                ready += closed() if blocks else []
                conv, blocks = row["conv"], []
                sums = {"cost": [0, NEVER, NEVER, NEVER], "rank": [0] * STATES, "least": None, "most": None, "initial": None, **dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)}
            costs, ranks, before, keys = [NEVER] * STATES, [0] * STATES, [0] * STATES, []
            for j in range(STATES):
                options = [(sums["cost"][i] + row["costs"][4 * i + j], sums["rank"][i], i) for i in range(STATES) if sums["cost"][i] < NEVER and row["costs"][4 * i + j] < NEVER]
                if options:
                    costs[j], first, before[j] = min(options)
                    keys.append((first, row["ranks"][4 * before[j] + j], j))
            for place, (_, _, j) in enumerate(sorted(keys)):
                ranks[j] = place
            sums["cost"], sums["rank"] = costs, ranks
            blocks.append((row["part"], row["at"], tuple(before)))
            for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
                sums[k] += row[k]
            if sums["initial"] is not None:
                sums["illegal"] += sums["initial"] + row["first_initial"] not in LEGAL_PAIRS
            sums["initial"] = row["last_initial"]
            if row["least"] is not None:
                sums["turns"] -= sums["most"] == row["least"]
                sums["least"] = row["least"] if sums["least"] is None else sums["least"]
                sums["most"] = row["most"]
            if len(ready) >= 500:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in ready], schema)
                ready = []
    ready += closed() if blocks else []
    if ready:
        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in ready], schema)


def _audits(rounds: tuple):
    """Puts the audit of each block in the place of its symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _evaluator(rounds)
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()  # noqa: E731, B023
            parts = compressed(get("symbols"), own.rounds)
            audits = [own.audit(s.tolist(), i, j) + (tail or "") for s, i, j, tail in zip(parts, get("begin"), get("end"), get("tail"), strict=True)]
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if n not in ("symbols", "begin", "end", "tail")}
            yield pa.RecordBatch.from_pydict({**columns, "audit": pa.array(audits, pa.string())})

    return run


# ---- results -------------------------------------------------------------------

SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Writer:
    """Applies the edits of one conversation to its rows as they come and hashes what is left."""

    def __init__(self):
        self.hash, self.state, self.empty = hashlib.sha256(), START, True
        self.audit, self.open, self.at, self.sums = [], "", 0, dict.fromkeys(SUMS, 0)

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.empty = False

    def more(self, row: dict) -> None:
        """The audit of the next block."""
        self.audit.append(row["audit"])
        self.open, self.at = self.open[self.at :] + row["audit"], 0
        if row["cost"] is not None:
            self.sums = {k: row[k] for k in SUMS}

    def insert(self) -> None:
        while self.open[self.at : self.at + 1] == "I":
            self.state = FOLLOWS[self.state]
            self._line(NAMES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.open[self.at]
        self.at += 1
        if edit == "K":
            self.state = SYSTEM if role[:1] == "s" else FOLLOWS[self.state]
            self._line(role, text)
        elif edit == "R":
            self.state = FOLLOWS[self.state]
            self._line(NAMES[self.state], text)

    def result(self) -> dict:
        self.insert()
        return {**self.sums, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _written(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("conv_id", kind), *((k, pa.int64()) for k in SUMS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
        conv, conv_id, writer, ready, size = None, None, None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None or row["conv"] != conv:
                    if writer is not None:
                        ready.append({"conv_id": conv_id, **writer.result()})
                        size += len(ready[-1]["audit"])
                        if len(ready) >= 500 or size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(ready, pa.schema(types))
                            ready, size = [], 0
                    conv, conv_id, writer = row["conv"], None, _Writer()
                if row["audit"] is not None:
                    writer.more(row)
                    continue
                conv_id = row["conv_id"]
                for _ in range(row["copies"]):
                    writer.row(row["role"], row["text"])
        if writer is not None:
            ready.append({"conv_id": conv_id, **writer.result()})
        if ready:
            yield pa.RecordBatch.from_pylist(ready, pa.schema(types))

    return run


def repaired(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row per conversation: counts of faults, cost and audit of the cheapest edits, hash of the repaired rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = prepare(rows.sparkSession)
    rows = damaged(rows, conversation)
    stored = lambda df, name: (df.write.parquet(path := scratch_path(spark, name)), spark.read.parquet(path))[1]
    units = stored(faults(rows), "turns")
    in_order = units.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    blocks = stored(in_order.mapInArrow(_blocks, _BLOCKS), "blocks")
    rounds = _frozen(grammar(stored(blocks.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "sequences")))

    carried = ["conv", "part", "at", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "least", "most", "turns"]
    kinds = dict(x.split() for x in _BLOCKS.split(", "))
    matrices = blocks.select("symbols", *carried).mapInArrow(
        _block_matrices(rounds), ", ".join([*(f"{n} {kinds[n]}" for n in carried), "costs array<long>", "ranks array<int>"])
    )
    walks = matrices.repartition("conv").sortWithinPartitions("conv", "part", "at").mapInArrow(_walks, _ENDS)
    keyed = blocks.select("conv", "turn", "role", "digest", "part", "at", "symbols").join(walks, ["part", "at"])
    kept = ["conv", "turn", "role", "digest", "part", "at", *SUMS]
    audits = keyed.select(*kept, "symbols", "begin", "end", "tail").mapInArrow(
        _audits(rounds), ", ".join([*(f"{n} {kinds.get(n, 'long')}" for n in kept), "audit string"])
    )
    text = F.when(F.col("copies") > 0, F.col("text"))
    every = rows.withColumn("text", text).unionByName(audits, allowMissingColumns=True)
    stream = every.withColumn("tag", F.col("audit").isNull()).repartition("conv").sortWithinPartitions("conv", *ORDER, "tag", "part", "at")
    kind = rows.schema["conv_id"].dataType
    result = ", ".join([f"conv_id {kind.simpleString()}", *(f"{k} long" for k in SUMS), "audit string", "repaired_sha256 string"])
    return stream.select("conv_id", "conv", "role", "text", "copies", "audit", *SUMS).mapInArrow(_written(to_arrow_type(kind)), result)
