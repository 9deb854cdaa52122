"""Conversation structure repair: cheapest edits by bidirectional Dijkstra.

A conversation's rows should spell ``(s?(ua)+)?`` by the initials of their roles.
The edit lattice has a node for each number of rows consumed and each state of
that pattern; its edges keep, rerole or delete the next row or insert a turn.  A
forward heap from the start and a reverse heap from the end settle nodes by cost
until their tops add up to more than the best crossing; then all cheapest paths
cross an edge between a node settled forward and one settled backward, and the
least of their audits (prefix and suffix of least spelling) is taken.  Letters
tell the path: of user and assistant only one can follow a state.

Long conversations: rows are range-partitioned by conversation and turn, so that
a conversation may lie in many tasks, and searched in segments of at most
``SEGMENT`` rows.  A segment gives the cheapest edits from each state to each;
segments follow one another (inserts stand before a row, so audits of one border
are never prefixes of each other and their order is kept as ranks).  A
conversation that lies in one partition ends there; only those that cross a
border of partitions have their segments brought together, one bounded segment
at a time.  The digest of a repaired conversation is defined over its whole text
in order, so those bytes (nothing else) pass one task in sequence.

Results: null conversation, turn, role or text: one blank where a text is needed;
null turns stand first and a null conversation is one conversation.  Rows of one
turn are in order of role, then text.  Repeated rows count each.  A conversation
without rows after damage has zeros, an empty audit and the digest of the empty
text.  An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import NON_WS, python_ready, written

SEGMENT = 512
#: characters after which a segment, or a batch of results, is full
SEGMENT_CHARS = 4_000_000
BLANKS = " \t\n\x0b\x0c\r"
#: states of the pattern: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: the one state that a rerole or an insert leads to, and its role
WRITTEN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: a row of a lattice: initial of its role, must it be deleted, cost of its text if kept, times
#: (rows in succession that must go are one step)
Row = tuple[str, bool, int, int]


def steps(row: Row, state: int) -> list[tuple[str, int, int]]:
    """Edges over one row: (letters, cost, next state)."""
    initial, gone, extra, times = row
    out = [("D" * times, DELETE * times, state)]
    if not gone:
        kept = NEXT[state].get(initial)
        if kept is not None:
            out.append(("K", extra, kept))
        if kept != WRITTEN[state]:
            out.append(("R", REROLE + extra, WRITTEN[state]))
    return out


def cheapest(rows: list[Row], source: int, targets: tuple[int, ...], last: bool) -> tuple[int, str, int] | None:
    """Cost, least audit and end state of the cheapest edits of ``rows`` from
    state ``source`` to one of ``targets``; with ``last`` turns may also be
    inserted after the last row."""
    n = len(rows)
    back: list[list[list[tuple[str, int, int]]]] = [[[] for _ in range(4)] for _ in range(n + 1)]
    ahead: list[list[list[tuple[str, int, int, int]]]] = [[[] for _ in range(4)] for _ in range(n + 1)]
    for i in range(n + 1):
        for s in range(4):
            edges = [(w, c, i + 1, t) for w, c, t in steps(rows[i], s)] if i < n else []
            if i < n or last:
                edges.append(("I", INSERT, i, WRITTEN[s]))
            ahead[i][s] = edges
            for w, c, j, t in edges:
                back[j][t].append((w, c, i * 4 + s))
    # per side: heap of (cost, distance walked in rows, node), best (cost, audit), settled
    fwd, rev = [(0, 0, source)], [(0, 0, n * 4 + t) for t in targets]
    fbest, rbest = {source: (0, "")}, {node: (0, "") for _, _, node in rev}
    fdone: set[int] = set()
    rdone: set[int] = set()
    best = None
    crossings: list[tuple[int, int, str, int]] = []  # cost of the path, edge from, letters, to
    while fwd and rev and (best is None or fwd[0][0] + rev[0][0] <= best):
        if fwd[0][0] <= rev[0][0]:
            cost, _, node = heappop(fwd)
            if node in fdone or cost > fbest[node][0]:
                continue
            fdone.add(node)
            audit = fbest[node][1]
            for w, c, j, t in ahead[node >> 2][node & 3]:
                to, new = j * 4 + t, (cost + c, audit + w)
                if to in rdone:
                    total = new[0] + rbest[to][0]
                    crossings.append((total, node, w, to))
                    best = total if best is None or total < best else best
                if to not in fbest or new < fbest[to]:
                    if to not in fbest or new[0] < fbest[to][0]:
                        heappush(fwd, (new[0], j, to))
                    fbest[to] = new
        else:
            cost, _, node = heappop(rev)
            if node in rdone or cost > rbest[node][0]:
                continue
            rdone.add(node)
            audit = rbest[node][1]
            for w, c, frm in back[node >> 2][node & 3]:
                new = (cost + c, w + audit)
                if frm in fdone:
                    total = new[0] + fbest[frm][0]
                    crossings.append((total, frm, w, node))
                    best = total if best is None or total < best else best
                if frm not in rbest or new < rbest[frm]:
                    if frm not in rbest or new[0] < rbest[frm][0]:
                        heappush(rev, (new[0], n - (frm >> 2), frm))
                    rbest[frm] = new
    if source >> 2 == n and source in targets:  # no rows and nothing to do
        return 0, "", source
    if best is None:
        return None
    audit = min(fbest[u][1] + w + rbest[v][1] for total, u, w, v in crossings if total == best)
    return best, audit, walk(rows, source, audit)[0]


def walk(rows: list[Row], state: int, audit: str) -> tuple[int, list[tuple[str | None, int]]]:
    """End state and repaired turns of an audit: (new role or None, row or -1)."""
    out: list[tuple[str | None, int]] = []
    i, left = 0, 0
    for letter in audit:
        if letter == "I":
            state = WRITTEN[state]
            out.append((ROLE[state], -1))
            continue
        if letter == "D":
            left = (left or rows[i][3]) - 1
            i += left == 0
            continue
        if letter == "R":
            state = WRITTEN[state]
            out.append((ROLE[state], i))
        else:
            state = NEXT[state][rows[i][0]]
            out.append((None, i))
        i += 1
    return state, out


class Repair:
    """Running result of one conversation: for each state that its last border
    can have the cost, the audit (linked pieces), the digest so far and the rank
    of the audit among the states."""

    def __init__(self) -> None:
        self.live = {START: (0, None, hashlib.sha256(), 0, 0)}
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.tail: str | None = None  # initial of the last row so far
        self.turns: list[int | None] = [None, None, None]  # smallest, largest, last
        self.distinct = 0

    def count(self, counts: list[int], head: str | None, tail: str | None, first: int | None, last: int | None, distinct: int) -> None:
        for k, v in enumerate(counts):
            self.counts[k] += v
        if head is not None:
            self.counts[3] += self.tail is not None and self.tail + head not in LEGAL
            self.tail = tail
        if first is not None:
            self.distinct += distinct - (self.turns[2] == first)
            self.turns = [first if self.turns[0] is None else self.turns[0], last, last]

    def follow(self, rows: list[Row], texts: list[tuple[str, str]], edits: dict[tuple[int, int], tuple[int, str]]) -> None:
        """Go on over a segment whose cheapest edits from state to state are ``edits``."""
        found: dict[int, list] = {}
        for (p, q), (cost, audit) in edits.items():
            if p in self.live:
                found.setdefault(q, []).append((self.live[p][0] + cost, self.live[p][3], audit, p))
        chosen = sorted((min(options)[1:], min(options)[0], q) for q, options in found.items())
        live = {}
        for rank, ((_, audit, p), cost, q) in enumerate(chosen):
            _, before, sha, _, n = self.live[p]
            sha = sha.copy()
            for role, i in walk(rows, p, audit)[1]:
                own, text = texts[i] if i >= 0 else ("", "")
                sha.update((("\n" if n else "") + (role or own) + ":" + text).encode("utf-8", "surrogatepass"))
                n += 1
            live[q] = (cost, (before, audit), sha, rank, n)
        self.live = live

    def result(self) -> tuple:
        self.follow([], [], {(p, q): (r[0], r[1]) for p in self.live for q in (START, ASSISTANT)
                             if (r := cheapest([], p, (q,), True)) is not None})
        cost, _, _, linked, sha = min((c, rank, q, linked, sha) for q, (c, linked, sha, rank, _) in self.live.items())
        pieces = []
        while linked is not None:
            linked, audit = linked
            pieces.append(audit)
        low, high, _ = self.turns
        gaps = 0 if low is None else high - low + 1 - self.distinct
        return (gaps, *self.counts, cost, "".join(reversed(pieces)), sha.hexdigest())


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
N_RESULT = 8
#: a segment of a conversation that crosses a border of partitions
OPEN = ("counts array<bigint>, head string, tail string, first bigint, last bigint, distinct_turns bigint, froms array<int>, tos array<int>, "
        "costs array<bigint>, audits array<string>, initials array<string>, gone array<boolean>, extra array<int>, times array<int>, "
        "roles array<string>, texts array<string>")


class Segment:
    """At most ``size`` rows of one conversation and what they count for."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.texts: list[tuple[str, str]] = []
        self.counts = [0, 0, 0, 0]
        self.head = self.tail = None
        self.first = self.last = None
        self.distinct = self.chars = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int, later: bool) -> None:
        """``fault``: 0 none, 1 blank, 3 truncated; ``later``: role and text stood
        in the conversation before."""
        initial = role[:1]
        if self.head is None:
            self.head = initial
        self.counts[3] += (self.tail is not None and self.tail + initial not in LEGAL) + copies - 1  # a row and its copy: never legal
        self.tail = initial
        if turn is not None:
            self.distinct += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if fault == 1:
            self.counts[0] += copies
            gone = copies
        else:
            gone = copies if later else copies - 1
            self.counts[1] += gone
            if not later:
                self.counts[2] += fault == 3
                self.rows.append((initial, False, TRUNCATED if fault == 3 else 0, 1))
                self.texts.append((role, text))
                self.chars += len(text)
        if gone:
            if self.rows and self.rows[-1][1]:
                self.rows[-1] = ("", True, 0, self.rows[-1][3] + gone)
            else:
                self.rows.append(("", True, 0, gone))
                self.texts.append(("", ""))


    def full(self, size: int) -> bool:
        return len(self.rows) >= size or self.chars >= SEGMENT_CHARS

    def repaired(self) -> tuple:
        """The result for a conversation that is this one segment."""
        cost, audit, _ = cheapest(self.rows, START, (START, ASSISTANT), True)
        turns = ((role or self.texts[i][0]) + ":" + (self.texts[i][1] if i >= 0 else "") for role, i in walk(self.rows, START, audit)[1])
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (gaps, *self.counts, cost, audit, hashlib.sha256("\n".join(turns).encode("utf-8", "surrogatepass")).hexdigest())


def _edits(rows: list[Row], sources: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, str]]:
    return {(p, q): (r[0], r[1]) for p in sources for q in range(4) if (r := cheapest(rows, p, (q,), False)) is not None}


def search(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies, fault, later) to one row per
    conversation: conv_id and ``RESULT``.  Rows with 0 copies only name their conversation."""
    spark = rows.sparkSession
    python_ready(spark)
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    fields = [f.split()[0] for f in f"{RESULT}, {OPEN}".split(", ")]
    schema = f"conv_id {conv_type}, part int, nr bigint, {RESULT}, {OPEN}"

    def batch_of(out: list[tuple], spark_types: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), spark_types)], schema=spark_types)

    def types(key: pa.DataType) -> pa.Schema:
        lists = {"counts": pa.int64(), "froms": pa.int32(), "tos": pa.int32(), "costs": pa.int64(), "audits": pa.string(), "initials": pa.string(),
                 "gone": pa.bool_(), "extra": pa.int32(), "times": pa.int32(), "roles": pa.string(), "texts": pa.string()}
        strings = {"audit", "repaired_sha256", "head", "tail"}
        return pa.schema([("conv_id", key), ("part", pa.int32()), ("nr", pa.int64()),
                          *[(f, pa.list_(lists[f]) if f in lists else pa.string() if f in strings else pa.int64()) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nr = TaskContext.get().partitionId(), 0
        current: object = run  # no conversation yet
        opening = True  # the first conversation may have begun in another partition
        seg, before, schema_, out, chars = Segment(), None, None, [], 0

        def opened() -> tuple:
            """The segment as a row; what it costs from any state, as the state
            at its start is not known here."""
            e = _edits(seg.rows, (0, 1, 2, 3)) if seg.rows else {(s, s): (0, "") for s in range(4)}
            return (current, part, nr, *[None] * N_RESULT, seg.counts, seg.head, seg.tail, seg.first, seg.last, seg.distinct,
                    [p for p, _ in e], [q for _, q in e], [c for c, _ in e.values()], [a for _, a in e.values()],
                    [r[0] for r in seg.rows], [r[1] for r in seg.rows], [r[2] for r in seg.rows], [r[3] for r in seg.rows],
                    [t[0] for t in seg.texts], [t[1] for t in seg.texts])

        # the last conversation of a partition may go on in the next one: it stays open too
        for batch in batches:
            schema_ = schema_ or types(batch.schema.field(0).type)
            for conv, turn, role, text, copies, fault, later in zip(*[c.to_pylist() for c in batch.columns]):
                if conv != current or current is run:
                    if current is not run:
                        out.append(opened() if opening else (current, part, nr, *seg.repaired(), *[None] * (len(fields) - N_RESULT)))
                        chars += seg.chars
                        opening = False
                    current, nr, seg, before = conv, 0, Segment(), None
                if copies:
                    seg.add(turn, role, text, copies, fault, later or before == (turn, role, text))
                    before = (turn, role, text)
                if seg.full(segment):  # a long conversation: its segments are brought together below
                    opening = True
                    out.append(opened())
                    chars += seg.chars
                    nr, seg = nr + 1, Segment()
                if len(out) >= 500 or chars >= SEGMENT_CHARS:
                    yield batch_of(out, schema_)
                    out, chars = [], 0
        if current is not run:
            out.append(opened())
        if out:
            yield batch_of(out, schema_)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = together
        state, keys, out = Repair(), None, []
        for batch in batches:
            keys = keys or batch.schema.field(0).type
            cols = {name: batch.column(name) for name in batch.schema.names}
            for r in range(batch.num_rows):
                at = {name: col[r].as_py() for name, col in cols.items()}
                if at["conv_id"] != current or current is together:
                    if current is not together:
                        out.append((current, *state.result()))
                    current, state = at["conv_id"], Repair()
                state.count(at["counts"], at["head"], at["tail"], at["first"], at["last"], at["distinct_turns"])
                rows = list(zip(at["initials"], at["gone"], at["extra"], at["times"]))
                edits = {(p, q): (c, a) for p, q, c, a in zip(at["froms"], at["tos"], at["costs"], at["audits"])}
                if rows:
                    state.follow(rows, list(zip(at["roles"], at["texts"])), edits)
        if current is not together:
            out.append((current, *state.result()))
        if out:
            yield batch_of(out, pa.schema([f for f in types(keys) if f.name in ("conv_id", *fields[:N_RESULT])]))

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.select("conv_id", "turn", "role", "text", "copies", "fault", "later").repartitionByRange(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 32))
    found = written(dealt.sortWithinPartitions(*order).mapInArrow(run, schema), "turn-segments")
    names = ["conv_id", *fields[:N_RESULT]]
    whole = found.where(F.col("audit").isNotNull()).select(*names)
    parts = found.where(F.col("audit").isNull()).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "nr")
    return whole.unionByName(parts.mapInArrow(together, f"conv_id {conv_type}, {RESULT}"))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of ``conv_id:turn``, with ``copies`` (0: the
    row is dropped and only names its conversation)."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20).alias("h")
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), named("role").alias("role"), named("text").alias("text"), h)
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("h") == 0, "").otherwise(text).alias("text"),
                       F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1).alias("copies"))


def _fault(text: Column) -> Column:
    end = F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)
    return F.when(~text.rlike(NON_WS), 1).when(~end.isin(".", "!", "?"), 3).otherwise(0)


def repaired(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text,
    copies): a row per conversation."""
    # first place of a role and text that stand at several turns; only digests are moved for it
    light = rows.where("copies > 0").select("conv_id", "role", F.sha2("text", 256).alias("digest"),
                                            F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("t")).alias("at"))
    again = (light.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.max("at").alias("final"))
             .where(~F.col("first").eqNullSafe(F.col("final")))
             .select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first"))
    flagged = rows.withColumn("_digest", F.sha2("text", 256)).join(
        again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_digest") == F.col("_d")), "left")
    here = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("t"))
    return search(flagged.select("conv_id", "turn", "role", "text", "copies", _fault(F.col("text")).alias("fault"),
                                 F.coalesce(here > F.col("first"), F.lit(False)).alias("later")), segment)
