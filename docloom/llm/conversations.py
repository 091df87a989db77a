"""Conversation structure repair by signatures.

Every message becomes one letter for its role and fault, so that a conversation is a compact string, its signature. A cheapest
repair depends on the signature alone: each distinct one is solved once, by recursion over its suffixes, and the edits
(the audit) are joined back to all conversations that share it and replayed over their messages.

Very long conversations are strings of several blocks. A block's solution is the least cost from each state it may be entered in
to each it may be left in; these are folded from a conversation's end, so that every block knows what each way out still costs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import _crc
from docloom.llm._common import joined, mapped, saved

#: Messages of a block, as a power of two.
BLOCK_BITS = 7
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What the repaired roles have come to: nothing, system, user, assistant; and the cost of ending there.
NONE, SYSTEM, USER, ASSISTANT = range(4)
AT_END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40
_KEPT = {("s", NONE): SYSTEM, ("u", NONE): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_FORCED = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: b"user", ASSISTANT: b"assistant"}
_BLANK, _MARK = "[\\x20\\x09-\\x0D]", "[.!?]"
REPAIRS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults made by the checksum of ``conv_id:turn``; nulls count as one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", _MARK, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("again")).drop("again")


def ordered(rows: DataFrame) -> DataFrame:
    """The messages with ``pos``, which grows with (conv_id, turn, role, hash of the text), nulls first. Ranges are sampled and a
    message's whole place is the key, so one conversation, or one turn of it, may spread over many tasks."""
    place = ["conv_id", "turn", "role", "hash", "part"]
    rows = rows.withColumn("hash", F.unhex(F.sha2("text", 256))).withColumn("part", F.spark_partition_id())
    out = rows.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("pos", F.monotonically_increasing_id())
    whole = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role"), F.concat("role", "text"))
    return out.select("conv_id", "pos", "turn", "role", "text", F.unhex(F.sha2(whole, 256)).alias("key"))


def letter(repeated: Column) -> Column:
    """b: blank, d: duplicate; else s, u, a or o (another role), as a capital where the text is truncated."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    truncated = ~F.col("text").rlike(f"{_MARK}{_BLANK}*\\z")
    return F.when(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), "b").when(repeated, "d").when(truncated, F.upper(role)).otherwise(role)


def blocks(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(conv_id, pos, faults, sig): the letters of up to 2 ** ``bits`` neighbouring messages of one conversation."""
    first = rows.groupBy("key").agg(F.min("pos").alias("first"), F.count("*").alias("held"))
    slim = rows.select("conv_id", "pos", "key", letter(F.lit(True)).alias("l2"), letter(F.lit(False)).alias("l"))
    slim = saved(slim, "letters")
    told = joined(slim, saved(first.where("held > 1"), "repeats"), "key", slim.count(), "left")
    told = told.select("conv_id", "pos", F.when(F.col("pos") > F.col("first"), F.col("l2")).otherwise(F.col("l")).alias("l"))
    found = told.groupBy("conv_id", F.shiftright("pos", bits).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "l"))).alias("x"))
    faults = F.concat_ws("", F.col("x.l"))
    return found.select("conv_id", F.col("x")[0]["pos"].alias("pos"), faults.alias("faults"), F.translate(faults, "bd", "xx").alias("sig"))


class Solver:
    """Least costs by (suffix of a signature, state), shared between signatures."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, int], tuple[int, ...]] = {}

    def edits(self, letter: str, state: int) -> Iterator[tuple[str, int, int]]:
        """(initial, cost, next state) of what may be done with a message, or before it."""
        yield "D", DELETE, state
        yield "I", INSERT, _FORCED[state]
        if letter != "x":
            more = TRUNCATED if letter.isupper() else 0
            if (kept := _KEPT.get((letter.lower(), state))) is not None:
                yield "K", KEEP + more, kept
            yield "R", REROLE + more, _FORCED[state]

    def costs(self, sig: str, state: int) -> tuple[int, ...]:
        """The least cost of editing ``sig`` from a state to each state. More than two insertions in a row lead nowhere new."""
        if not sig:
            return tuple(0 if k == state else NEVER for k in range(4))
        found = self.known.get((sig, state))
        if found is None:
            best, now = [NEVER] * 4, state
            for n in range(3):
                for initial, cost, after in self.edits(sig[0], now):
                    if initial != "I":
                        best = [min(b, n * INSERT + cost + c) for b, c in zip(best, self.costs(sig[1:], after), strict=True)]
                now = _FORCED[now]
            found = self.known[sig, state] = tuple(best)
        return found

    def left(self, sig: str, state: int, ahead: tuple[int, ...]) -> int:
        return min(a + b for a, b in zip(self.costs(sig, state), ahead, strict=True))

    def audit(self, sig: str, state: int, ahead: tuple[int, ...]) -> str:
        """The ASCII-least of the cheapest edits: the least initial that the least cost allows, message by message."""
        out = []
        while sig:
            due = self.left(sig, state, ahead)
            for initial, cost, after in self.edits(sig[0], state):
                rest = sig if initial == "I" else sig[1:]
                if cost + self.left(rest, after, ahead) == due:
                    out.append(initial)
                    sig, state = rest, after
                    break
        return "".join(out)

    def trimmed(self) -> None:
        if len(self.known) > 200_000:
            self.known.clear()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(schema), schema, strict=True)], schema=schema)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solver, schema = Solver(), pa.schema([("sig", pa.string()), ("held", pa.int64()), ("costs", pa.list_(pa.int64()))])
    for batch in batches:
        yield _batch([(s, n, [c for state in range(4) for c in solver.costs(s, state)]) for s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)], schema)
        solver.trimmed()


def _aheads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's last block to its first: what each state that a block is left in still costs."""
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("faults", pa.string()), ("sig", pa.string()), ("ahead", pa.string())])
    at, ahead = (), AT_END
    for batch in batches:
        out = []
        for conv, pos, faults, sig, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (conv,):
                at, ahead = (conv,), AT_END
            least = min(ahead)  # differences are all that counts, and those stay small
            out.append((conv, pos, faults, sig, ",".join(str(c - least) for c in ahead)))
            ahead = tuple(min(costs[4 * k + j] + ahead[j] for j in range(4)) - least for k in range(4))
        yield _batch(out, schema)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solver, schema = Solver(), pa.schema([("sig", pa.string()), ("ahead", pa.string()), ("held", pa.int64()), ("audits", pa.list_(pa.string()))])
    for batch in batches:
        yield _batch([(s, a, n, [solver.audit(s, state, tuple(map(int, a.split(",")))) for state in range(4)]) for s, a, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)], schema)
        solver.trimmed()


def audited(found: DataFrame) -> DataFrame:
    """The blocks with ``audits``, one for each state that the block may be entered in."""
    found = saved(found, "blocks")
    total = found.count()
    solved = saved(mapped(found.groupBy("sig").agg(F.count("*").alias("held")), _solved, "sig string, held long, costs array<long>"), "solved")
    known = joined(found, solved, "sig", total).select("conv_id", "pos", "faults", "sig", "costs")
    known = known.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("pos"))
    known = saved(mapped(known, _aheads, "conv_id long, pos long, faults string, sig string, ahead string"), "aheads")
    audits = saved(mapped(known.groupBy("sig", "ahead").agg(F.count("*").alias("held")), _audited, "sig string, ahead string, held long, audits array<string>"), "audits")
    return joined(known, audits, ["sig", "ahead"], total).select("conv_id", "pos", "faults", "audits")


class Replay:
    """One conversation, message by message; of its text only a running hash is kept."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys("bdt", 0)
        self.illegal = self.cost = self.distinct = 0
        self.audit: list[str] = []
        self.state, self.before = NONE, ""
        self.first_turn = self.last_turn = None
        self.hash, self.lines = hashlib.sha256(), 0

    def block(self, faults: str, audits: list[str]) -> None:
        self.faults, self.edits = iter(faults), iter(audits[self.state])
        self.audit.append(audits[self.state])

    def written(self, role: bytes, text: bytes) -> None:
        self.hash.update((b"\n" if self.lines else b"") + role + b":" + text)
        self.lines += 1

    def inserted(self) -> None:
        self.state = _FORCED[self.state]
        self.cost += INSERT
        self.written(_NAMES[self.state], b"")

    def message(self, turn: int | None, role: bytes, text: bytes) -> None:
        fault = next(self.faults)
        truncated = fault.isupper()
        self.counts["t" if truncated else fault] = self.counts.get("t" if truncated else fault, 0) + 1
        initial = role[:1].decode("ascii", "replace")
        self.illegal += bool(self.before) and self.before + initial not in ("su", "ua", "au")
        self.before = initial or " "
        if turn is not None:
            self.distinct += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        while (edit := next(self.edits)) == "I":
            self.inserted()
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += (TRUNCATED if truncated else 0) + (REROLE if edit == "R" else KEEP)
        self.state = _FORCED[self.state] if edit == "R" else _KEPT[fault.lower(), self.state]
        self.written(_NAMES[self.state] if edit == "R" else role, text)

    def result(self) -> tuple:
        for _ in range(AT_END[self.state] // INSERT):
            self.audit.append("I")
            self.inserted()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct
        return gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_OUT = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in REPAIRS.split(", ")])


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream of conversations (kind 0), their blocks (1) and messages (2), sorted by (conv_id, pos, kind)."""
    at, replay = None, None
    for batch in batches:
        out = []
        for conv, _, kind, turn, role, text, faults, audits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                if replay:
                    out.append((at, *replay.result()))
                at, replay = conv, Replay()
            elif kind == 1:
                replay.block(faults, audits)
            else:
                replay.message(turn, role, text)
        yield _batch(out, _OUT)
    if replay:
        yield _batch([(at, *replay.result())], _OUT)


def replayed(conversations: DataFrame, rows: DataFrame, audits: DataFrame) -> DataFrame:
    """One row per conversation. Messages come by in order, one at a time: a hash over a conversation's repaired text is one
    sequential pass over it, so that of a huge one takes one task long, but no more memory."""
    null = lambda kind: F.lit(None).cast(kind)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    heads = ids.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("kind"), null("long").alias("turn"), null("binary").alias("role"), null("binary").alias("text"), null("string").alias("faults"), null("array<string>").alias("audits"))
    parts = audits.select("conv_id", "pos", F.lit(1), null("long"), null("binary"), null("binary"), "faults", "audits")
    messages = rows.select("conv_id", "pos", F.lit(2), "turn", F.col("role").cast("binary"), F.col("text").cast("binary"), null("string"), null("array<string>"))
    whole = heads.union(parts).union(messages).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    return mapped(whole, _replayed, REPAIRS)


def repaired(conversations: DataFrame, damage: bool = True, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per conv_id: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Null texts, roles and ids count as one space; a null conv_id is one conversation, null turns stand first. Ties of turn are ordered by
    role and by SHA-256 of the text, so repeated rows are neighbours and all but the first are duplicates. Conversations and
    texts may have any length. Other columns, whatever their names, aren't read; an empty table gives an empty result.
    """
    plain = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    rows = saved(ordered(damaged(conversations) if damage else plain), "messages")
    return replayed(conversations, rows, audited(blocks(rows, bits)))


def _cheapest(state: int) -> str:
    """SQL: of all ways into a state over one message, that with the least (cost, audit); the repaired text comes along."""
    ways = []
    for start in range(4):
        now, inserts, lines = start, "", ""
        for n in range(3):

            def way(initial: str, cost: int, line: str = "", more: str = "0") -> str:
                key = f"lpad((p{start}.k[:6]::int + {n * INSERT + cost} + {more})::varchar, 6, '0') || p{start}.k[7:] || '{inserts}{initial}'"  # noqa: B023
                return f"{{'k': {key}, 't': p{start}.t{lines}{line}}}"  # noqa: B023

            if now == state:
                ways.append(way("D", DELETE))
            if _FORCED[now] == state:
                ways.append(f"case when l <> 'x' then {way('R', REROLE, f" || chr(10) || '{_NAMES[state].decode()}:' || text", 'e')} end")
            for role, before in _KEPT:
                if before == now and _KEPT[role, before] == state:
                    ways.append(f"case when l = '{role}' then {way('K', KEEP, ' || chr(10) || role || chr(58) || text', 'e')} end")
            now = _FORCED[now]
            inserts += "I"
            lines += f" || chr(10) || '{_NAMES[now].decode()}:'"
    return "list_sort(list_filter([" + ", ".join(ways) + "], lambda x: x.k is not null))[1]"


def oracle() -> str:
    """The same in DuckDB, without signatures: all conversations advance by one message a round, by their four states."""
    at_end = [f"{{'k': lpad((p{k}.k[:6]::int + {AT_END[k]})::varchar, 6, '0') || p{k}.k[7:] || '{'I' * (AT_END[k] // INSERT)}', 't': p{k}.t || {['\'\'', "chr(10) || 'user:' || chr(10) || 'assistant:'", "chr(10) || 'assistant:'", '\'\''][k]}}}" for k in range(4)]
    return f"""
with recursive {_crc.STEPS},
given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as h from conversations),
kinds as (select *, {_crc.of_hex('h')} % 20 as kind from given, steps),
hurt as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when kind = 3 then [0, 1] else [0] end) as again
  from kinds where kind <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), again) as n from hurt),
faulty as (
  select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'd'
                 when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 't' else '' end as fault,
         lag(role) over (partition by conv_id order by n) as before
  from placed),
told as (
  select conv_id, n, role, text, case when fault in ('b', 'd') then 'x' when role[1] in ('s', 'u', 'a') then role[1] else 'o' end as l, case when fault = 't' then {TRUNCATED} else 0 end as e
  from faulty),
walk(conv_id, n, p0, p1, p2, p3) as (
  select distinct conv_id, 0::bigint, {{'k': '000000', 't': ''}}, null::struct(k varchar, t varchar), null::struct(k varchar, t varchar), null::struct(k varchar, t varchar) from given
  union all
  select w.conv_id, m.n, {_cheapest(NONE)}, {_cheapest(SYSTEM)}, {_cheapest(USER)}, {_cheapest(ASSISTANT)}
  from walk w join told m on m.conv_id is not distinct from w.conv_id and m.n = w.n + 1),
ends as (
  select conv_id, list_sort(list_filter([{', '.join(at_end)}], lambda x: x.k is not null))[1] as r
  from (select *, row_number() over (partition by conv_id order by n desc) as back from walk) where back = 1),
sums as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
         count(*) filter (before is not null and before[1] || role[1] not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, r.k[:6]::bigint as cost, r.k[7:] as audit, sha256(r.t[2:]) as repaired_sha256
from ends e left join sums s on s.conv_id is not distinct from e.conv_id
"""
