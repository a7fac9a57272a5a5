"""Repair of the structure of conversations by weighted interval parsing.

A whole conversation is an optional system turn and pairs of a user and an assistant turn. The states of
its automaton are 0 start, 1 after the system turn, 2 after a user, 3 after an assistant turn; 0 and 3
may end it. The repair grammar in Chomsky normal form has a symbol X(p, q) for "these rows, edited, lead
from state p to state q":

- X(p, q) -> X(p, r) X(r, q) joins neighbouring spans, for every state r between;
- X(p, q) -> row, by keeping, reroling or deleting it;
- X(p, q) -> nothing, by inserting turns. This closure is applied at both ends of every row.

A cell holds, for a span of rows and each symbol, the least (cost, audit). Cells are filled bottom-up by
span length: rows, pairs of rows, fours and so on. As a rule exists for every state r, each split of
a span gives the same cell, so one split will do and only spans of doubling length are filled.

The least pair may be chosen cell by cell: two audits of one span that cost the same are never prefixes of
one another (the longer one would hold further inserts, which cost), so they differ at some letter and
what follows cannot turn their order.

How it is spread out: rows are range-partitioned by (conversation, turn), so a long conversation lies in
several partitions. Each partition emits one cell per conversation and span of at most ``SPAN_ROWS``
rows; the spans of a conversation are then joined 64 at a time. Only (cost, audit) cells move, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterscope.llm.common import BLANKS, save, shards, small

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits, and what a truncated row costs that stays.
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_STAYS = 5
#: Next state by state and initial of the role; no entry where the turn may not come.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = ((0, 0), (0, 3))
ROLES = {"u": "user", "a": "assistant"}
#: Initial of the turn that an insert or a new role gives in each state.
WANTED = {p: c for p in range(4) for c in "ua" if (p, c) in NEXT}

#: Rows of a conversation in one span of a partition, and spans that are joined at a time.
SPAN_ROWS, SPANS_AT_ONCE = 4096, 64
ROWS_PER_RANGE = 500_000

Cell = tuple  # (cost, audit) or None for each of SYMBOLS


def _reached() -> list[tuple[int, int]]:
    """The pairs of states of which the second can be reached from the first."""
    pairs = {(p, p) for p in range(4)}
    while more := {(p, q) for p, r in pairs for (s, _), q in NEXT.items() if s == r} - pairs:
        pairs |= more
    return sorted(pairs)


SYMBOLS = _reached()
_AT = {symbol: i for i, symbol in enumerate(SYMBOLS)}
#: For each symbol X(p, q) the places of X(p, r) and X(r, q).
RULES = [
    [(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in SYMBOLS
]


def join(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for rules in RULES:
        best = None
        for i, j in rules:
            a, b = left[i], right[j]
            if a is not None and b is not None:
                cost = a[0] + b[0]
                if best is None or cost <= best[0]:
                    found = (cost, a[1] + b[1])
                    if best is None or found < best:
                        best = found
        out.append(best)
    return tuple(out)


def _closure() -> Cell:
    """The empty span: the fewest inserts that lead from one state to the other."""
    step = {(p, NEXT[p, c]) for p, c in WANTED.items()}
    once = tuple((COSTS[INSERT], INSERT) if symbol in step else None for symbol in SYMBOLS)
    cell = tuple((0, "") if p == q else None for p, q in SYMBOLS)
    for _ in range(4):
        longer = join(cell, once)
        cell = tuple(min((x for x in pair if x is not None), default=None) for pair in zip(cell, longer))
    return cell


def row_cell(initial: str, fault: str) -> Cell:
    """The cell of one row: keep, rerole or delete, with inserts before and after."""
    stays = TRUNCATED_STAYS if fault == "truncated" else 0
    options: dict[tuple[int, int], list] = {symbol: [] for symbol in SYMBOLS}
    for p in range(4):
        options[p, p].append((COSTS[DELETE], DELETE))
        if fault in ("blank", "duplicate"):
            continue
        if (p, initial) in NEXT:
            options[p, NEXT[p, initial]].append((COSTS[KEEP] + stays, KEEP))
        options[p, NEXT[p, WANTED[p]]].append((COSTS[REROLE] + stays, REROLE))
    edited = tuple(min(options[symbol], default=None) for symbol in SYMBOLS)
    empty = _closure()
    return join(join(empty, edited), empty)


def best_repair(cell: Cell | None) -> tuple[int, str]:
    """The cheapest (cost, audit) of a whole conversation; one without rows needs none."""
    if cell is None:
        return 0, ""
    return min(cell[_AT[symbol]] for symbol in ACCEPTED if cell[_AT[symbol]] is not None)


# A span as it travels: the cells, and counts that add up over neighbouring spans.
SPAN = (
    "conv_id long, part long, number long, costs array<long>, audits array<string>, first string, last string, "
    "low long, high long, turns long, illegal long, blank long, duplicate long, truncated long"
)
_SPAN_TYPES = (
    [("conv_id", pa.int64()), ("part", pa.int64()), ("number", pa.int64())]
    + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
    + [("first", pa.string()), ("last", pa.string())]
    + [(n, pa.int64()) for n in ("low", "high", "turns", "illegal", "blank", "duplicate", "truncated")]
)
_SPAN_ARROW = pa.schema(_SPAN_TYPES)
LEGAL = ("su", "ua", "au")


def _joined_span(left: dict, right: dict) -> dict:
    known = [s for s in (left, right) if s["turns"]]
    met = len(known) == 2 and left["high"] == right["low"]
    return {
        "cell": join(left["cell"], right["cell"]),
        "first": left["first"],
        "last": right["last"],
        "low": known[0]["low"] if known else None,
        "high": known[-1]["high"] if known else None,
        "turns": left["turns"] + right["turns"] - met,
        "illegal": left["illegal"] + right["illegal"] + (left["last"] + right["first"] not in LEGAL),
        **{f: left[f] + right[f] for f in ("blank", "duplicate", "truncated")},
    }


def _span_of_row(turn: int | None, initial: str, fault: str, cells: dict) -> dict:
    # Cells of rows depend on the initial, of which only three count, and on the fault.
    kind = (initial if initial in "sua" else "", fault)
    if kind not in cells:
        cells[kind] = row_cell(*kind)
    return {
        "cell": cells[kind],
        "first": initial,
        "last": initial,
        "low": turn,
        "high": turn,
        "turns": int(turn is not None),
        "illegal": 0,
        **{f: int(fault == f) for f in ("blank", "duplicate", "truncated")},
    }


def _bottom_up(spans: Iterator[dict]) -> dict:
    """Join neighbouring spans of equal length first, as in a binary counter; then what is left, from the right."""
    stack: list[tuple[int, dict]] = []
    for span in spans:
        length = 1
        while stack and stack[-1][0] == length:
            span, length = _joined_span(stack.pop()[1], span), 2 * length
        stack.append((length, span))
    whole = stack.pop()[1]
    while stack:
        whole = _joined_span(stack.pop()[1], whole)
    return whole


def _emitted(spans: list[tuple]) -> pa.RecordBatch:
    out = []
    for conv, part, number, span in spans:
        costs = [c and c[0] for c in span["cell"]]
        audits = [c and c[1] for c in span["cell"]]
        rest = {k: v for k, v in span.items() if k != "cell"}
        out.append({"conv_id": conv, "part": part, "number": number, "costs": costs, "audits": audits, **rest})
    return pa.RecordBatch.from_pylist(out, schema=_SPAN_ARROW)


def _spans(span_rows: int):
    """Cells of the runs of a conversation in one sorted partition."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict = {}
        number, out = 0, []

        def rows() -> Iterator[tuple]:
            seen, last = 0, ()
            for batch in batches:
                for part, conv, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                    seen = seen + 1 if (conv,) == last else 0
                    last = (conv,)
                    yield (conv, seen // span_rows), part, turn, initial, fault

        for (conv, _), run in groupby(rows(), key=lambda r: r[0]):
            first = next(run)
            part = first[1]
            leaves = (_span_of_row(*r[2:], cells) for r in (x for y in ([first], run) for x in y))
            out.append((conv, part, number, _bottom_up(leaves)))
            number += 1
            if len(out) == 512:
                yield _emitted(out)
                out = []
        if out:
            yield _emitted(out)

    return task


def _join_spans(rows: pa.Table) -> pa.Table:
    ordered = rows.sort_by([("part", "ascending"), ("number", "ascending")]).to_pylist()
    for row in ordered:
        pairs = zip(row.pop("costs"), row.pop("audits"))
        row["cell"] = tuple(None if c is None else (c, a) for c, a in pairs)
    whole = _bottom_up(iter(ordered))
    return pa.Table.from_batches([_emitted([(ordered[0]["conv_id"], ordered[0]["part"], ordered[0]["number"], whole)])])


def _whole_spans(spans: DataFrame, at_once: int) -> DataFrame:
    """One span per conversation, joined ``at_once`` neighbours at a time."""
    done = []
    while True:
        counted = spans.groupBy("conv_id").agg(F.count(F.lit(1)).alias("spans"))
        many = small(save(counted.where("spans > 1").select(F.col("conv_id").alias("of")), "repair-many"), 16)
        same = F.col("conv_id").eqNullSafe(F.col("of"))
        if many.isEmpty():
            done.append(spans)
            break
        done.append(spans.join(many, same, "left_anti"))
        # A row for every few thousand turns of the long conversations.
        rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "number")) - 1
        lots = spans.join(many, same).drop("of").withColumn("lot", F.floor(rank / at_once))
        joined = lots.groupBy("conv_id", "lot").applyInArrow(lambda t: _join_spans(t.drop_columns(["lot"])), SPAN)
        spans = save(joined, "repair-spans")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        repairs = []
        for costs, audits in zip(batch.column("costs").to_pylist(), batch.column("audits").to_pylist()):
            repairs.append(best_repair(tuple(None if c is None else (c, a) for c, a in zip(costs, audits))))
        named = [batch.column(c) for c in ("conv_id", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")]
        cost, audit = pa.array([r[0] for r in repairs], pa.int64()), pa.array([r[1] for r in repairs], pa.string())
        names = ["conv_id", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        yield pa.RecordBatch.from_arrays([*named, cost, audit], names)


def _is_blank(text: Column) -> Column:
    return F.length(F.btrim(text, F.lit(BLANKS))) == 0


def _is_truncated(text: Column) -> Column:
    return ~F.substring(F.btrim(text, F.lit(BLANKS)), -1, 1).isin(".", "!", "?")


def _numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, two hashes of role and text, and a number for each row; saved."""
    one = F.lit(" ")
    return save(
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role"), one).alias("role"),
            F.coalesce(F.col("text"), one).alias("text"),
        ).select(
            "*",
            F.xxhash64("role", "text").alias("hash"),
            F.xxhash64(F.lit("second"), F.col("role"), F.col("text")).alias("hash2"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "repair-rows",
    )


#: Order of the rows of a table of :func:`_numbered`. Rows with equal role and text lie side by side in a turn.
ORDER = ["conv_id", "turn", "hash", "hash2", "row"]


def _repeats(rows: DataFrame) -> DataFrame:
    """The rows whose role and text come earlier in their conversation: their numbers."""
    said = ["conv_id", "hash", "hash2"]
    firsts = save(
        rows.groupBy(*said)
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "row")).alias("first"))
        .where("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("hash").alias("h"), F.col("hash2").alias("h2"), F.col("first.row").alias("first")),
        "repair-firsts",
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")) & (F.col("hash2") == F.col("h2"))
    return rows.select(*said, "row").join(small(firsts, 48), same).where("row <> first").select("row")


def repairs(conversations: DataFrame, span_rows: int = SPAN_ROWS, at_once: int = SPANS_AT_ONCE) -> DataFrame:
    """One row per conversation with rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows go by turn, null turns first, and within a turn by hashes of role and text; a null role or text
    counts as one blank. Null ids are one conversation. The first fault of a row counts: blank
    (nothing but ASCII white space), duplicate (its role and text came earlier in the conversation), truncated (the last
    other character is not ``.``, ``!`` or ``?``). ``gaps`` is the greatest turn less the smallest, plus one, less the distinct
    turns, nulls aside; ``illegal`` counts neighbours whose role initials are not su, ua or au.

    The repair is the cheapest sequence of edits, :data:`COSTS`, after which the role initials read
    ``(s?(ua)+)?``; blank and duplicate rows must go. ``audit`` holds the initials of the edits in order;
    of equally cheap ones it is the smallest in ASCII order. An empty table gives no rows; other columns
    are not read.
    """
    return _repairs(_numbered(conversations), span_rows, at_once)


def _repairs(rows: DataFrame, span_rows: int = SPAN_ROWS, at_once: int = SPANS_AT_ONCE) -> DataFrame:
    spark = rows.sparkSession
    repeats = save(_repeats(rows), "repair-repeats")
    fault = (
        F.when(_is_blank(F.col("text")), "blank")
        .when(F.col("repeat").isNotNull(), "duplicate")
        .when(_is_truncated(F.col("text")), "truncated")
        .otherwise("")
    )
    judged = rows.join(small(repeats, 8).withColumnRenamed("row", "repeat"), F.col("row") == F.col("repeat"), "left").select(
        *ORDER, F.substring("role", 1, 1).alias("initial"), fault.alias("fault")
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards(rows.count(), ROWS_PER_RANGE))
    sorted_ = judged.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    spans = sorted_.select(
        F.spark_partition_id().cast("long").alias("part"), "conv_id", "turn", "initial", "fault"
    ).mapInArrow(_spans(span_rows), SPAN)
    whole = _whole_spans(save(spans, "repair-spans"), at_once)
    summary = "conv_id long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return save(
        whole.mapInArrow(_summaries, summary).select(
            "conv_id",
            F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps"),
            "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        ),
        "repair-found",
    )


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (conv_id, position, edit, role, text) from the audit of each conversation and, after it, its rows."""
    conv, audit, at, state, position = None, "", 0, 0, 0

    def inserts() -> list[tuple]:
        nonlocal at, state, position
        found = []
        while at < len(audit) and audit[at] == INSERT:
            initial = WANTED[state]
            found.append((conv, position, INSERT, ROLES[initial], ""))
            state, position, at = NEXT[state, initial], position + 1, at + 1
        return found

    for batch in batches:
        out = []
        for this, found, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if found is not None:
                conv, audit, at, state, position = this, found, 0, 0, 0
                out += inserts()
                continue
            edit = audit[at]
            at += 1
            if edit != DELETE:
                initial = role[0] if edit == KEEP else WANTED[state]
                out.append((conv, position, edit, role if edit == KEEP else ROLES[initial], text))
                state, position = NEXT[state, initial], position + 1
            out += inserts()
        yield out


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    )
    for rows in _edited(batches):
        columns = list(zip(*rows)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation, taken up turn by turn."""
    conv, digest = (), None

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        ids, sums = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])

    for rows in _edited(batches):
        found = []
        for this, _, _, role, text in rows:
            if (this,) != conv:
                if digest:
                    found.append((conv[0], digest.hexdigest()))
                conv, digest = (this,), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if found:
            yield batch_of(found)
    if digest:
        yield batch_of([(conv[0], digest.hexdigest())])


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The audit of each conversation ahead of its rows in their order; a conversation lies in one partition,
    which reads it as a stream."""
    heads = found.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ORDER[1:]], "audit",
                         F.lit("").alias("role"), F.lit("").alias("text"))
    turns = rows.select("conv_id", F.lit(1).alias("kind"), *ORDER[1:], F.lit(None).cast("string").alias("audit"), "role", "text")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards(rows.count(), ROWS_PER_RANGE))
    streams = heads.unionByName(turns).repartition(parts, "conv_id")
    return streams.sortWithinPartitions("conv_id", "kind", *ORDER[1:]).select("conv_id", "audit", "role", "text")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, edit, role, text``: the turns of the repaired conversations, positions from 0.

    Deleted rows are left out; inserted turns have an empty text. See :func:`repairs` for the rules.
    """
    rows = _numbered(conversations)
    return _with_audits(rows, _repairs(rows)).mapInArrow(
        _turn_rows, "conv_id long, position long, edit string, role string, text string"
    )


def repair_digests(conversations: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of :func:`repairs` with ``repaired_sha256`` of the repaired ``role:text`` lines.

    ``known`` (conv_id) adds a row of zeros, with the digest of an empty text, for conversations without rows.
    """
    rows = _numbered(conversations)
    found = _repairs(rows)
    digests = _with_audits(rows, found).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    digests = digests.withColumnRenamed("conv_id", "digest_of")
    ids = known.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    result = found.withColumnRenamed("conv_id", "found_in")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = ids.join(result, F.col("conv_id").eqNullSafe(F.col("found_in")), "left").join(
        digests, F.col("conv_id").eqNullSafe(F.col("digest_of")), "left"
    )
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with damage drawn by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``.``, ``!`` and ``?`` from it, 3 repeats the row in the same turn, 4 makes
    it a user turn; others stay. Nulls count as one blank, but a null id or turn stays null.
    """
    one = F.lit(" ")
    of = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    draw, text = F.col("draw"), F.coalesce(F.col("text"), one)
    return (
        conversations.select("conv_id", "turn", "role", "text", F.pmod(F.crc32(of.cast("binary")), F.lit(20)).alias("draw"))
        .where("draw <> 0")
        .withColumn("copy", F.explode(F.when(draw == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select(
            "conv_id",
            "turn",
            F.when(draw == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), one)).alias("role"),
            F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        )
    )
