"""Conversations repaired by the cheapest edits of their turns.

The repaired roles must alternate: perhaps a system turn, then user and assistant
in pairs. A conversation's edit lattice has a node for each (turns read, role
last written); an edit is a link that reads a turn (keep, give it another role,
delete) or writes one (insert). The cheapest way through is found from both ends:
a forward and a reverse heap grow until the sum of their least costs is over the
best meeting, so that all equally cheap crossings are finished, and of these the
least audit (the edits' initials, one after another) is taken.

Two equally cheap ways to one node never have an audit that begins the other:
the longer one would have inserts besides, which cost. So the least audit of a
whole is the least of its parts, whichever end they are put together from. That
makes the least audit of a node a label of a shortest-path search, and it lets a
conversation of any length be cut: a block of ``BLOCK`` turns is searched once
for each pair of roles at its ends, and blocks are joined pair by pair, a few at
a time. Only conversations longer than a block take that way; the others are one
task's stream of turns.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsieve.llm.common import durable, ranked, table

#: Turns and bytes of text up to which a conversation is held by one task, and turns of a block beyond.
BLOCK, BLOCK_BYTES = 1024, 1 << 24
#: Blocks that are joined at once.
JOINED = 16
#: Bytes of repaired text that travel as one row to the hash of a long conversation.
PIECE_BYTES = 1 << 20
#: Costs of edits, and of a truncated turn that stays (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What is written last: nothing, a system, user or assistant turn. The role that must follow each.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
COMPLETE = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
WRITES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Faults of a turn, the first that holds (fixed values).
SOUND, BLANK, DUPLICATE, CUT = range(4)
BLANKS = " \t\n\v\f\r"

Turn = tuple[str, int]


def _edits(turn: Turn, last: int) -> Iterator[tuple[int, str, int]]:
    """(cost, initial, role written last after it) of the edits that read a turn."""
    initial, fault = turn
    yield DELETE, "D", last
    if fault in (SOUND, CUT):
        more = TRUNCATED if fault == CUT else 0
        yield REROLE + more, "R", FOLLOWS[last]
        to = WRITES.get(initial)
        if to is not None and (to == FOLLOWS[last] or (to == SYSTEM and last == START)):
            yield more, "K", to


def cheapest(turns: list[Turn], start: int = START, goals: tuple[int, ...] = COMPLETE) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of turns (role's initial, fault) that lead from ``start`` to one of ``goals``; None if nothing does."""
    n = len(turns)
    ahead: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    back: dict[tuple[int, int], tuple[int, str]] = {(n, g): (0, "") for g in goals}
    # within one cost, nodes go in the order of the turns read: only keeping a turn is free
    forward, reverse = [(0, 0, start)], [(0, 0, g) for g in goals]
    done_ahead: set[tuple[int, int]] = set()
    done_back: set[tuple[int, int]] = set()
    into: list[list[tuple[int, int, str, int]] | None] = [None] * n
    best = float("inf")
    while forward and reverse and forward[0][0] + reverse[0][0] <= best:
        if forward[0][0] <= reverse[0][0]:
            cost, at, last = heapq.heappop(forward)
            node = (at, last)
            if node in done_ahead:
                continue
            done_ahead.add(node)
            audit = ahead[node][1]
            if node in back:
                best = min(best, cost + back[node][0])
            links = [(INSERT, "I", (at, FOLLOWS[last]))]
            if at < n:
                links += [(w, c, (at + 1, to)) for w, c, to in _edits(turns[at], last)]
            for w, c, to in links:
                label = (cost + w, audit + c)
                if to not in ahead or label < ahead[to]:
                    if to not in ahead or label[0] < ahead[to][0]:
                        heapq.heappush(forward, (label[0], to[0], to[1]))
                    ahead[to] = label
                if to in back:
                    best = min(best, label[0] + back[to][0])
        else:
            cost, left, last = heapq.heappop(reverse)
            at = n - left
            node = (at, last)
            if node in done_back:
                continue
            done_back.add(node)
            audit = back[node][1]
            if node in ahead:
                best = min(best, cost + ahead[node][0])
            links = [(INSERT, "I", (at, p)) for p in range(4) if FOLLOWS[p] == last]
            if at:
                if into[at - 1] is None:
                    into[at - 1] = [(p, w, c, to) for p in range(4) for w, c, to in _edits(turns[at - 1], p)]
                links += [(w, c, (at - 1, p)) for p, w, c, to in into[at - 1] if to == last]
            for w, c, source in links:
                label = (cost + w, c + audit)
                if source not in back or label < back[source]:
                    if source not in back or label[0] < back[source][0]:
                        heapq.heappush(reverse, (label[0], n - source[0], source[1]))
                    back[source] = label
                if source in ahead:
                    best = min(best, label[0] + ahead[source][0])
    # every cheapest way has a link from a node done ahead to one done back, or a node that both reached
    met: tuple[int, str] | None = None
    for node in done_ahead:
        cost, audit = ahead[node]
        at, last = node
        ends = [(0, "", node), (INSERT, "I", (at, FOLLOWS[last]))]
        if at < n:
            ends += [(w, c, (at + 1, to)) for w, c, to in _edits(turns[at], last)]
        for w, c, to in ends:
            if to in back and cost + w + back[to][0] <= best:
                way = (cost + w + back[to][0], audit + c + back[to][1])
                met = way if met is None or way < met else met
    return met


def faults(turns: list[tuple[str, str]]) -> list[int]:
    """The first fault of each (role, text) of a conversation in order."""
    seen, found = set(), []
    for turn in turns:
        rest = turn[1].rstrip(BLANKS)
        found.append(BLANK if not rest else DUPLICATE if turn in seen else SOUND if rest[-1] in ".!?" else CUT)
        seen.add(turn)
    return found


def _illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def repaired(turns: Iterable[tuple[str, str]], audit: str, last: int = START) -> Iterator[tuple[str, str]]:
    """The turns that an audit leaves and writes, after a turn of the role ``last``."""
    rest = iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES[FOLLOWS[last]]
        last = WRITES[role[:1]]
        yield role, text


def _bytes(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode("utf-8", "surrogatepass")


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of each run of rows that agree in the columns of ``key``; rows are read as they are asked for."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    return itertools.groupby(rows(), key=lambda r: r[: len(key)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= size or weight > BLOCK_BYTES:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COUNTS = [(c, pa.int64()) for c in SUMMARY]


def _whole(rows: DataFrame, turns: bool) -> DataFrame:
    """Of conversations that a task may hold, the summaries or the repaired turns."""
    conv = rows.schema["conv"].dataType.simpleString()
    kind = pa.int64() if conv in ("bigint", "int", "smallint", "tinyint") else pa.string()
    if turns:
        schema = pa.schema([("conv", kind), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        out = "conv {}, position long, role string, text string"
    else:
        schema = pa.schema([("conv", kind), *_COUNTS, ("audit", pa.string()), ("digest", pa.string())])
        out = "conv {}, " + ", ".join(f"{c} long" for c in SUMMARY) + ", audit string, digest string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (key,), own in _runs(batches, ["conv"]):
            numbers, said = [], []
            for _, turn, role, text in own:
                numbers.append(turn)
                said.append((role, text))
            found = faults(said)
            cost, audit = cheapest([(role[:1], fault) for (role, _), fault in zip(said, found, strict=True)])
            if turns:
                yield from ((key, i, *x) for i, x in enumerate(repaired(said, audit)))
                continue
            digest = hashlib.sha256(b"\n".join(_bytes(*x) for x in repaired(said, audit))).hexdigest()
            known = {x for x in numbers if x is not None}
            gaps = max(known) - min(known) + 1 - len(known) if known else 0
            yield key, gaps, *(found.count(x) for x in (BLANK, DUPLICATE, CUT)), sum(_illegal(a[0][:1], b[0][:1]) for a, b in zip(said, said[1:], strict=False)), cost, audit, digest

    dealt = rows.select("conv", "turn", "role", "text").repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(lambda batches: _batches(each(batches), schema), out.format(conv))


#: Every pair of roles at the ends of a block.
PAIRS = [(p, q) for p in range(4) for q in range(4)]
_NODE = [("conv", None), ("node", pa.int64()), ("nodes", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
_NODE_SQL = "conv {}, node long, nodes long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>"


def _block_node(codes: list[Turn]) -> tuple:
    """Counts, end initials and the cheapest edits of each pair of roles."""
    ways = [cheapest(codes, p, (q,)) for p, q in PAIRS]
    illegal = sum(_illegal(a[0], b[0]) for a, b in zip(codes, codes[1:], strict=False))
    counts = [sum(x == fault for _, x in codes) for fault in (BLANK, DUPLICATE, CUT)]
    return *counts, illegal, codes[0][0], codes[-1][0], [w and w[0] for w in ways], [w and w[1] for w in ways]


def _joined(nodes: list[dict]) -> tuple:
    """As ``_block_node``, of consecutive nodes together."""
    illegal = sum(x["illegal"] for x in nodes) + sum(_illegal(a["last"], b["first"]) for a, b in zip(nodes, nodes[1:], strict=False))
    ways = {(p, q): (0, "") if p == q else None for p, q in PAIRS}
    for node in nodes:
        step = {pair: None if cost is None else (cost, audit) for pair, cost, audit in zip(PAIRS, node["costs"], node["audits"], strict=True)}
        ways = {(p, q): min(((a[0] + b[0], a[1] + b[1]) for m in range(4) if (a := ways[p, m]) and (b := step[m, q])), default=None) for p, q in PAIRS}
    return *(sum(x[c] for x in nodes) for c in ("blank", "duplicate", "truncated")), illegal, nodes[0]["first"], nodes[-1]["last"], [ways[x] and ways[x][0] for x in PAIRS], [ways[x] and ways[x][1] for x in PAIRS]


def _cut(rows: DataFrame, turns: bool) -> DataFrame:
    """As ``_whole``, of conversations of any length."""
    block = BLOCK
    conv = rows.schema["conv"].dataType.simpleString()
    kind = pa.int64() if conv in ("bigint", "int", "smallint", "tinyint") else pa.string()
    placed = durable(ranked(rows.select("conv", "turn", "role", "text"), ["conv"], ["turn", "role", "text"]).withColumn("block", F.expr(f"index div {block}")))
    # the first of equal turns is found without meeting them: a place is a first place or not
    firsts = placed.groupBy("conv", "role", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text", F.length("text")).alias("b")).agg(F.min("index").alias("_index")).select(F.col("conv").alias("_conv"), "_index")
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(rest == "", BLANK).when(F.col("_index").isNull(), DUPLICATE).when(F.right(rest, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    coded = placed.join(firsts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("index") == F.col("_index")), "left").select("conv", "block", "total", "index", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    blocks = coded.groupBy("conv", "block").agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("index", "initial", "fault"))).alias("codes"))
    schema = pa.schema([(n, t or kind) for n, t in _NODE])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for key, at, total, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield key, at, -(-total // block), *_block_node([(x["initial"], x["fault"]) for x in codes])

        return _batches(each(), schema, 16)

    nodes = durable(blocks.mapInArrow(search, _NODE_SQL.format(conv)))

    def join(group: pa.Table) -> pa.Table:
        own = group.sort_by("node").to_pylist()
        one = own[0]
        return pa.Table.from_batches([_batch([(one["conv"], one["node"] // JOINED, -(-one["nodes"] // JOINED), *_joined(own))], schema)])

    while nodes.where("nodes > 1").limit(1).count():
        nodes = durable(nodes.groupBy("conv", F.expr(f"node div {JOINED}").alias("parent")).applyInArrow(join, _NODE_SQL.format(conv)))
    ends = [PAIRS.index((START, g)) for g in COMPLETE]
    ways = F.array_min(F.array(*(F.when(F.get("costs", F.lit(i)).isNotNull(), F.struct(F.get("costs", F.lit(i)).alias("cost"), F.get("audits", F.lit(i)).alias("audit"))) for i in ends)))
    found = durable(nodes.select("conv", "blank", "duplicate", "truncated", "illegal", ways.alias("way")).select("conv", "blank", "duplicate", "truncated", "illegal", "way.cost", "way.audit"))
    # an audit is dealt out to its blocks, each with how much was written before it and what came last
    edits = pa.schema([("conv", kind), ("block", pa.int64()), ("index", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("written", pa.int64()), ("before", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for key, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    # turns are written in pairs but for the system's
                    system = sum(edit != "D" for edit in audit) % 2
                    begin = read = written = at = 0
                    for i, edit in enumerate([*audit, "end"]):
                        if edit == "end" or (edit != "I" and read == (at + 1) * block):
                            before = START if not written else SYSTEM if written == system else USER if (written - system) % 2 else ASSISTANT
                            yield key, at, -1, None, audit[begin:i], written, before
                            written += sum(x != "D" for x in audit[begin:i])
                            begin, at = i, at + 1
                        read += edit != "I"

        return _batches(each(), edits)

    none = F.lit(None).cast("long")
    dealt = found.select("conv", "audit").mapInArrow(deal, f"conv {conv}, block long, index long, role string, text string, written long, before long").unionByName(placed.select("conv", "block", "index", "role", "text", none.alias("written"), none.alias("before")))
    dealt = dealt.repartition("conv", "block").sortWithinPartitions("conv", "block", "index")
    made = pa.schema([("conv", kind), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    pieces = pa.schema([("conv", kind), ("position", pa.int64()), ("bytes", pa.binary())])

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv, position, role, text) of each block's turns; position None ends a block."""
        for (key, _), own in _runs(batches, ["conv", "block"]):
            _, _, _, _, audit, written, before = next(own)
            for i, (role, text) in enumerate(repaired(((x[3], x[4]) for x in own), audit, before)):
                yield key, written + i, role, text
            yield key, None, None, None

    if turns:
        return dealt.mapInArrow(lambda batches: _batches((x for x in edited(batches) if x[1] is not None), made), f"conv {conv}, position long, role string, text string")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, begin = bytearray(), None
        for key, position, role, text in edited(batches):
            if position is not None:
                begin = position if begin is None else begin
                held += b"\n" * (position > 0) + _bytes(role, text)
            if begin is not None and (position is None or len(held) > PIECE_BYTES):
                yield key, begin, bytes(held)
                held, begin = bytearray(), None

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (key,), own in _runs(batches, ["conv"]):
            state = hashlib.sha256()
            for _, _, piece in own:
                state.update(piece)
            yield key, state.hexdigest()

    texts = dealt.mapInArrow(lambda batches: _batches(packed(batches), pieces), f"conv {conv}, position long, bytes binary").repartition("conv").sortWithinPartitions("conv", "position")
    digests = texts.mapInArrow(lambda batches: _batches(hashed(batches), pa.schema([("conv", kind), ("digest", pa.string())])), f"_conv {conv}, digest string")
    numbers = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = placed.groupBy(F.col("conv").alias("_gap_conv")).agg(F.coalesce(numbers, F.lit(0)).alias("gaps"))
    out = found.join(gaps, F.col("conv").eqNullSafe(F.col("_gap_conv"))).join(digests, F.col("conv").eqNullSafe(F.col("_conv")), "left")
    return out.select("conv", *SUMMARY, "audit", F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("digest"))


#: Long conversations whose ids are broadcast at most; more of them meet their turns in a shuffled join.
BROADCAST = 1 << 16


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", turns: bool = False) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of every conversation; with ``turns`` its repaired turns (conv, position, role, text) instead.

    Turns go by number, nulls first; those of one number by role and text, so
    that equal ones are neighbours. A null role or text is one space; a null conv
    is a conversation of its own. The first fault of a turn counts: blank (blanks
    only), duplicate (role and text were there before), truncated (the last
    character that isn't blank is none of ``.!?``). gaps are the numbers missing
    between the least and the largest, illegal the neighbours whose role initials
    aren't su, ua or au. Blank and duplicate turns must be deleted; a turn whose
    role begins with another letter, or with none, can't be kept. digest is the
    SHA-256 of the repaired turns, each ``role:text``, joined by newlines. An
    empty table has no conversations. Other columns are left out, whatever their
    names.
    """
    id_type = rows.schema[conv].dataType.simpleString()
    id_ = F.col(f"`{conv}`") if id_type in ("bigint", "int", "smallint", "tinyint", "string") else F.col(f"`{conv}`").cast("string")
    own = rows.select(id_.alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), *(F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    sizes = own.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    large = durable(sizes.where((F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select(F.col("conv").alias("_conv")))
    n = large.limit(BROADCAST + 1).count()
    if not n:
        return _whole(own, turns)
    large = F.broadcast(large) if n <= BROADCAST else large
    same = F.col("conv").eqNullSafe(F.col("_conv"))
    return _whole(own.join(large, same, "left_anti"), turns).unionByName(_cut(own.join(large, same, "left_semi"), turns))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) damaged by the checksum of ``conv_id:turn``, a null in any column being one space: of twenty remainders 0 drops a turn, 1 empties it, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    said = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.pmod(F.crc32(said.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged and repaired; a conversation that lost all its turns has zeros."""
    rows = table(spark, sf_dir, "conversations")
    found = repair(damage(rows))
    every = rows.select("conv_id").distinct()
    made = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return made.select("conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in SUMMARY), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
