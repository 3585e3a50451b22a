"""Structure repair of conversations: the cheapest edits that make the roles `(s?(ua)+)?`, by min-plus run-length DP.

Every row becomes a symbol of its role and its first fault. A conversation is cut into chunks of bounded length along one
global order; equal symbols in a row form a run, and a chunk's transition is the product of cached binary powers of the
4 x 4 min-plus matrices of its symbols. One backward scan over chunk matrices gives the cost to go at every chunk's end,
one forward scan over exit states gives the state at its start, and then each chunk unrolls its own choices. Rows meet in
chunks of at most `CHUNK`; the scans stream some numbers per chunk, so a conversation of any length needs bounded memory.

Edits: keep 0 (K), rerole to user or assistant 1 (R), delete 2 (D, required for blank and duplicate rows), insert an empty
user or assistant turn 5 (I); a truncated row that stays adds 5. Among the cheapest edits the ASCII-least string is taken.

Rules for odd rows: NULL role and text count as one space; rows are taken by turn (NULL first), then role, then the
SHA-256 of the text; equal rows are duplicates of the first; a NULL conv_id is a conversation of its own; other columns are
ignored; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from gridloom.operators.ranking import join_null_safe
from gridloom.session import stored

CHUNK = 4096  # rows of a conversation that meet in one place
NONE, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the role that came last
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, STAYS_TRUNCATED = 0, 1, 2, 5, 5
INFINITE = 1 << 60
FOLLOWS = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # role that an insert or a rerole gives
INITIALS = "sua"
ROLES = {USER: "user", ASSISTANT: "assistant"}

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    columns = list(zip(*b))
    return tuple(tuple(min(INFINITE, *(x + y for x, y in zip(row, column))) for column in columns) for row in a)


def applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(INFINITE, *(x + y for x, y in zip(row, v))) for row in a)


def inserts() -> Matrix:
    """Cost of any number of inserts between two states."""
    one = tuple(tuple(0 if p == q else INSERT if FOLLOWS[p] == q else INFINITE for q in range(4)) for p in range(4))
    return times(one, one)


#: Cost to end after the last row.
END: Vector = applied(inserts(), (0, INFINITE, INFINITE, 0))


def kept_state(state: int, initial: int) -> int | None:
    """State after a row whose role stays, or None if the role may not stand there."""
    if initial == 0:
        return SYSTEM if state == NONE else None
    return initial + 1 if initial < 3 and FOLLOWS[state] == initial + 1 else None


def parsed(symbol: str) -> tuple[int, int]:
    """(fault, place of the role's initial in `sua`, or 3)."""
    return divmod(ord(symbol) - 65, 4)


POWERS: dict[tuple[str, int], Matrix] = {}  # 16 symbols, exponents up to that of a chunk
KNOWN: dict[tuple, object] = {}  # results of whole chunks: conversations often have equal symbols
MOST_KNOWN = 1 << 14


def power(symbol: str, k: int) -> Matrix:
    """Min-plus transition of 2^k equal rows, inserts before each row included; cached."""
    if (symbol, k) not in POWERS:
        POWERS[symbol, k] = times(power(symbol, k - 1), power(symbol, k - 1)) if k else one_row(*parsed(symbol))
    return POWERS[symbol, k]


def known(key: tuple, made):
    """The value kept under a key, made if there is none; a full store starts anew."""
    if key not in KNOWN:
        if len(KNOWN) >= MOST_KNOWN:
            KNOWN.clear()
        KNOWN[key] = made()
    return KNOWN[key]


def one_row(fault: int, initial: int) -> Matrix:
    rows = [[INFINITE] * 4 for _ in range(4)]
    for p in range(4):
        rows[p][p] = DELETE
        if fault in (GOOD, TRUNCATED):
            extra = STAYS_TRUNCATED if fault == TRUNCATED else 0
            rows[p][FOLLOWS[p]] = min(rows[p][FOLLOWS[p]], REROLE + extra)
            q = kept_state(p, initial)
            if q is not None:
                rows[p][q] = min(rows[p][q], KEEP + extra)
    return times(inserts(), tuple(map(tuple, rows)))


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(s, len(list(group))) for s, group in groupby(symbols)]


def before_run(symbol: str, length: int, end: Vector) -> Vector:
    """Cost to go before a run, from the one behind it."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            end = applied(power(symbol, k), end)
    return end


def transition(symbols: str) -> Matrix:
    """Min-plus transition of a chunk."""
    columns = [tuple(0 if p == q else INFINITE for p in range(4)) for q in range(4)]
    for symbol, length in reversed(runs(symbols)):
        columns = [before_run(symbol, length, c) for c in columns]
    return tuple(zip(*columns))


def unrolled(symbols: str, end: Vector, state: int, last: bool) -> tuple[str, int]:
    """(ASCII-least cheapest edits of a chunk entered in `state`, state behind it); the last chunk ends the conversation."""
    kinds = runs(symbols)
    ends = [end]
    for symbol, length in reversed(kinds):
        ends.append(before_run(symbol, length, ends[-1]))
    edits: list[str] = []
    for (symbol, length), behind in zip(kinds, ends[-2::-1]):
        fault, initial = parsed(symbol)
        to_go = [behind]  # cost to go before each row of the run, last first
        for _ in range(length):
            to_go.append(applied(power(symbol, 0), to_go[-1]))
        for k in range(length, 0, -1):
            now, after = to_go[k], to_go[k - 1]
            while True:
                if DELETE + after[state] == now[state]:
                    edits.append("D")
                    break
                if INSERT + now[FOLLOWS[state]] == now[state]:
                    edits.append("I")
                    state = FOLLOWS[state]
                    continue
                extra = STAYS_TRUNCATED if fault == TRUNCATED else 0
                q = kept_state(state, initial)
                if q is not None and KEEP + extra + after[q] == now[state]:
                    edits.append("K")
                    state = q
                else:
                    edits.append("R")
                    state = FOLLOWS[state]
                break
    while last and END[state]:
        edits.append("I")
        state = FOLLOWS[state]
    return "".join(edits), state


def choices(symbols: str, end: Vector, state: int, last: bool) -> tuple[str, int]:
    return known((symbols, end, state, last), lambda: unrolled(symbols, end, state, last))


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, by the CRC-32 of `conv_id:turn` modulo 20 (NULL: one space):
    0 drops a row, 1 empties its text, 2 removes its `.`, `!` and `?`, 3 repeats it, 4 makes it a user's."""
    r = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20).alias("_k"),
    )
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_k") == 3, 2).otherwise(1))).alias("_copy")
    return r.where("_k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("_copy")


WHITE = r"\x20\x09-\x0D"


def _chunked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows in global order with `at`, one row per conversation and chunk with its string of symbols)."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    keyed = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of a conversation stand next to each other in this order; a long one may reach over partitions
    placed = stored(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    marks = placed.select("conv_id", "at", F.substring("role", 1, 1).alias("i"), blank.alias("blank"), (~F.col("text").rlike(rf"[.!?][{WHITE}]*\z")).alias("cut"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(GOOD)
    initial = F.when(F.col("i") == "s", 0).when(F.col("i") == "u", 1).when(F.col("i") == "a", 2).otherwise(3)
    symbols = marks.join(first, "at", "left").select("conv_id", "at", F.chr(F.lit(65) + fault * 4 + initial).alias("s"))
    chunk = F.expr(f"at div {CHUNK}")
    groups = symbols.groupBy("conv_id", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("rows"))
    return placed, groups.select("conv_id", "chunk", F.col("rows")[0]["at"].alias("start"), F.array_join(F.transform("rows", lambda x: x["s"]), "").alias("symbols"))


def _with(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    for name, values in columns.items():
        batch = batch.append_column(name, values)
    return batch


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [[x for row in known((s,), lambda s=s: transition(s)) for x in row] for s in batch.column("symbols").to_pylist()]
        yield _with(batch, costs=pa.array(costs, pa.list_(pa.int64())))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backward scan: chunks of a conversation come last first, over all batches of the partition."""
    conversation, to_go = object(), END
    for batch in batches:
        ends, lasts, before = [], [], []
        for conv, costs in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist()):
            lasts.append(conv != conversation)
            if conv != conversation:
                conversation, to_go = conv, END
            ends.append(list(to_go))
            to_go = applied(tuple(tuple(costs[4 * q : 4 * q + 4]) for q in range(4)), to_go)
            before.append(to_go[NONE])
        kept = batch.select([n for n in batch.schema.names if n != "costs"])
        yield _with(kept, end=pa.array(ends, pa.list_(pa.int64())), last=pa.array(lasts), cost=pa.array(before, pa.int64()))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("symbols").to_pylist(), batch.column("end").to_pylist(), batch.column("last").to_pylist())
        out = [[choices(s, tuple(e), q, last)[1] for q in range(4)] for s, e, last in rows]
        yield _with(batch, exits=pa.array(out, pa.list_(pa.int32())))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forward scan: the state in which each chunk is entered, and the initial before it ('' at the first chunk)."""
    conversation, state, initial = object(), NONE, ""
    for batch in batches:
        entries, befores = [], []
        for conv, exits, symbols in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "exits", "symbols"))):
            if conv != conversation:
                conversation, state, initial = conv, NONE, ""
            entries.append(state)
            befores.append(initial)
            state, initial = exits[state], symbols[-1]
        kept = batch.select([n for n in batch.schema.names if n != "exits"])
        yield _with(kept, entry=pa.array(entries, pa.int32()), before=pa.array(befores, pa.string()))


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and counts of every chunk."""
    for batch in batches:
        audits, counts = [], []
        for symbols, end, entry, last, before in zip(*(batch.column(c).to_pylist() for c in ("symbols", "end", "entry", "last", "before"))):
            audits.append(choices(symbols, tuple(end), entry, last)[0])
            faults = [parsed(s)[0] for s in symbols]
            initials = "".join((INITIALS + "-")[parsed(s)[1]] for s in before + symbols)
            counts.append([faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal_pairs(initials)])
        named = {n: pa.array([c[k] for c in counts], pa.int64()) for k, n in enumerate(("blank", "duplicate", "truncated", "illegal"))}
        yield _with(batch.select(["conv_id", "chunk", "start", "symbols", "entry", "cost", "before"]), audit=pa.array(audits, pa.string()), **named)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per edit: its place, the row it is about (NULL for an insert) and the role it gives (NULL: its own)."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("conv_id", "chunk", "place", "edit", "at", "new_role")}
        for conv, chunk, start, symbols, state, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "start", "symbols", "entry", "audit"))):
            row = 0
            for place, edit in enumerate(audit):
                role = None
                if edit in "IR":
                    state = FOLLOWS[state]
                    role = ROLES[state]
                elif edit == "K":
                    state = kept_state(state, parsed(symbols[row])[1])
                values = (conv, chunk, place, edit, None if edit == "I" else start + row, role)
                for column, value in zip(out.values(), values):
                    column.append(value)
                row += edit != "I"
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, turns) of conversations (conv_id, turn, role, text).

    report, one row per conversation: gaps (turn numbers missing between its least and largest), blank, duplicate,
    truncated (rows by their first fault), illegal (neighbours whose role initials are not su, ua or au), cost, audit.
    turns, the edits in order of (conv_id, chunk, place): edit, role and text of the repaired turn (deleted rows keep theirs).
    """
    placed, chunks = _chunked(rows)
    fields = {f.name: f for f in chunks.schema.fields}
    base = list(fields.values())
    numbers = ArrayType(LongType())
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(df: DataFrame) -> DataFrame:  # chunks of one conversation to many tasks
        return df.repartition(n, "conv_id", "chunk")

    matrices = chunks.mapInArrow(_transitions, StructType([*base, StructField("costs", numbers)]))
    back = matrices.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("chunk").desc())
    ended = [*base, StructField("end", numbers), StructField("last", chunks.select(F.lit(True).alias("last")).schema[0].dataType), StructField("cost", LongType())]
    exits = spread(back.mapInArrow(_ends, StructType(ended))).mapInArrow(_exits, StructType([*ended, StructField("exits", ArrayType(IntegerType()))]))
    forth = exits.repartition(n, "conv_id").sortWithinPartitions("conv_id", "chunk")
    entered = forth.mapInArrow(_entries, StructType([*ended, StructField("entry", IntegerType()), StructField("before", StringType())]))
    names = ("blank", "duplicate", "truncated", "illegal")
    shape = [*base, StructField("entry", IntegerType()), StructField("cost", LongType()), StructField("before", StringType()), StructField("audit", StringType())]
    audits = stored(spread(entered).mapInArrow(_audits, StructType([*shape, *[StructField(c, LongType()) for c in names]])), "audits")
    strings = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")
    first_cost = F.max(F.when(F.col("before") == "", F.col("cost"))).alias("cost")
    found = audits.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in names], first_cost, strings.alias("audit"))
    turns = placed.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    report = join_null_safe(found, gaps, ["conv_id"]).select("conv_id", "gaps", *names, "cost", "audit")
    edit_shape = StructType([fields["conv_id"], fields["chunk"], StructField("place", IntegerType()), StructField("edit", StringType()), StructField("at", LongType()), StructField("new_role", StringType())])
    edits = audits.mapInArrow(_edits, edit_shape)
    texts = placed.select("at", "role", "text")
    role, text = F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    return report, edits.join(texts, "at", "left").select("conv_id", "chunk", "place", "edit", role, text)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conversation, state, seen = None, None, False
    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        convs, hashes = [], []
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if not seen or conv != conversation:
                if seen:
                    convs.append(conversation)
                    hashes.append(state.hexdigest())
                conversation, state, seen = conv, sha256(line.encode()), True
            else:
                state.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([conversation], kind), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation's `role:text` lines. A hash is sequential, so one task streams a conversation's
    lines in order; it holds one batch of them at a time."""
    lines = turns.where("edit <> 'D'").select("conv_id", "chunk", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartition(n, "conv_id").sortWithinPartitions("conv_id", "chunk", "place").select("conv_id", "line")
    return ordered.mapInArrow(_hashed, StructType([turns.schema["conv_id"], StructField("repaired_sha256", StringType())]))


def digest(rows: DataFrame) -> DataFrame:
    """Report and hash of every conversation of `rows` after `damage`; conversations without rows left have zeros and empty strings."""
    report, turns = repair(damage(rows))
    known = rows.select("conv_id").distinct()
    out = join_null_safe(join_null_safe(known, report, ["conv_id"], "left"), digests(turns), ["conv_id"], "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, _filled("audit", ""), _filled("repaired_sha256", sha256(b"").hexdigest()))


def _filled(name: str, value: str) -> Column:
    return F.coalesce(name, F.lit(value)).alias(name)
