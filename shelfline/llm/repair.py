"""Conversation structure repair by prefix-doubling path ranking.

A conversation is repaired by edits that make its roles read ``(system? (user assistant)+)?``.  The edits are
arcs between nodes (rows that are left, state of the role pattern).  A cost DP from the end leaves the arcs of
the cheapest repairs.  Their nodes are ranked by the first 1, 2, 4, ... letters of the least audit that
starts there: a rank of twice the length is the rank of a pair of ranks, with the pointers doubled alongside.
The ranks pick each node's arc, and the doubled pointers spell out the path.  All conversations of a block are
worked on at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import crc32_sql, cut

BLANKS = " \t\n\x0b\x0c\r"
#: Rows, and bytes of text, that a task repairs at once; a conversation is never divided.
ROWS, TOGETHER = 1 << 16, 16 << 20

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: States by the role before: none, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state that each state's user or assistant leads to, and the one a kept row of an initial needs and reaches.
_NEXT = np.array([USER, USER, ASSISTANT, USER])
_KEPT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 40

_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, gone``, some of them damaged by the CRC of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays with ``gone``, so that its conversation is known), 1 empties the text, 2 takes
    its ``.!?``, 3 repeats it, 4 sets the role user.  Nulls read as one space.
    """

    def plain(column: str) -> Column:
        return F.coalesce(conversations[column].cast("string"), F.lit(" "))

    case = F.pmod(F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), case.alias("case")
    )
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time")
    return rows.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("case") == 0).alias("gone"), times).drop("time")


def untouched(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    names = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    typed = {c: conversations[c].cast(kind) for c, kind in names.items()}
    typed |= {c: F.coalesce(typed[c], F.lit(" ")) for c in ("role", "text")}
    return conversations.select(*[column.alias(c) for c, column in typed.items()], F.lit(False).alias("gone"))


def cheapest(starts: np.ndarray, initial: np.ndarray, must_go: np.ndarray, truncated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``cost`` of the nodes and ``optimal`` (nodes x letters KRDI): the target of each cheapest arc, else -1.

    The rows of conversation ``i`` are ``starts[i]`` to ``starts[i + 1]``.  Node ``(p + i) * 4 + state`` stands
    before row ``p`` of conversation ``i``; the node after its last row follows.
    """
    n_rows, n = int(starts[-1]), len(starts) - 1
    of = np.repeat(np.arange(n), np.diff(starts))
    cost = np.full((n_rows + n, 4), _FAR, np.int64)
    ends = starts[1:] + np.arange(n)
    cost[ends, NONE] = cost[ends, ASSISTANT] = 0
    kept = np.full((n_rows, 4), -1)
    for letter, moves in _KEPT.items():
        mine = (initial == letter) & ~must_go
        for state, then in moves.items():
            kept[mine, state] = then
    left = starts[1:][of] - 1 - np.arange(n_rows)  # rows after this one
    by_left = np.argsort(left, kind="stable")
    borders = np.searchsorted(left[by_left], np.arange(int(left.max(initial=-1)) + 2))
    arcs = np.full((n_rows + n, 4, 4), _FAR, np.int64)  # node, state, letter

    def inserts(at: np.ndarray) -> None:
        base = cost[at]
        pair = np.minimum(base[:, [USER, ASSISTANT]], INSERT_COST + base[:, [ASSISTANT, USER]])
        cost[at] = np.stack([np.minimum(base[:, NONE], INSERT_COST + pair[:, 0]), np.minimum(base[:, SYSTEM], INSERT_COST + pair[:, 0]), pair[:, 0], pair[:, 1]], axis=1)
        arcs[at, :, 3] = INSERT_COST + cost[at][:, _NEXT]

    inserts(ends)
    for t in range(len(borders) - 1):
        p = by_left[borders[t] : borders[t + 1]]
        at = p + of[p]
        after = cost[at + 1]
        stays = TRUNCATED_COST * truncated[p].astype(np.int64)[:, None]
        to = kept[p]
        arcs[at, :, 0] = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), axis=1) + stays, _FAR)
        arcs[at, :, 1] = np.where(must_go[p][:, None], _FAR, after[:, _NEXT] + REROLE_COST + stays)
        arcs[at, :, 2] = after + DELETE_COST
        cost[at] = arcs[at, :, :3].min(axis=2)
        inserts(at)
    node = np.arange(n_rows + n)[:, None] * 4
    rows = np.setdiff1d(np.arange(n_rows + n), ends, assume_unique=True)  # nodes with a row, in the order of the rows
    target = np.full((n_rows + n, 4, 4), -1)
    target[rows, :, 0] = node[rows] + 4 + kept
    target[rows, :, 1] = node[rows] + 4 + _NEXT
    target[rows, :, 2] = node[rows] + 4 + np.arange(4)
    target[:, :, 3] = node + _NEXT
    cheap = (arcs == cost[:, :, None]) & (cost[:, :, None] < _FAR)
    return cost.reshape(-1), np.where(cheap, target, -1).reshape(-1, 4)


def least_audits(starts: np.ndarray, optimal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``conversation, node, letter`` along every conversation's least audit, in order.

    The pattern leads every letter to one node, so equal prefixes of audits end at one node, and the
    node that a least prefix ends at is its doubled pointer.
    """
    n_nodes, n = len(optimal), len(starts) - 1
    letters = np.array([ord(c) for c in KEEP + REROLE + DELETE + INSERT])
    end = n_nodes  # audits that are over stay there and rank below every letter
    first = np.where(optimal >= 0, letters, 255).min(axis=1)
    over = first == 255
    arc = np.where(optimal >= 0, letters, 255).argmin(axis=1)
    pointer = np.append(np.where(over, end, optimal[np.arange(n_nodes), arc]), end)
    rank = np.append(np.where(over, 0, first), 0)
    pointers = [pointer]
    while (pointers[-1] != end).any():
        pair = rank.astype(np.int64) * (int(rank.max()) + 1) + rank[pointers[-1]]
        rank = np.unique(pair, return_inverse=True)[1]
        pointers.append(pointers[-1][pointers[-1]])
    # whole audits are ranked now: every node takes the arc of the least letter and then the least rank
    key = np.where(optimal >= 0, letters * (int(rank.max()) + 1) + rank[optimal], np.iinfo(np.int64).max)
    best = key.argmin(axis=1)
    at = (starts[:-1] + np.arange(n)) * 4 + NONE
    of, step = np.arange(n), np.zeros(n, np.int64)
    for k in range(len(pointers) - 1, -1, -1):  # the nodes at all multiples of 2 ** k steps
        on = pointers[k][at]
        more = on != end
        of, step, at = np.concatenate([of, of[more]]), np.concatenate([step, step[more] + (1 << k)]), np.concatenate([at, on[more]])
    order = np.lexsort((step, of))
    of, at = of[order], at[order]
    moves = ~over[at]
    return of[moves], at[moves], best[at[moves]]


def _block(conv: np.ndarray, columns: dict) -> pa.RecordBatch:
    """Results for whole conversations; ``columns`` are the rows, sorted by conversation and turn."""
    new = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    n = len(new)
    of = np.cumsum(np.concatenate([[0], (conv[1:] != conv[:-1]).astype(np.int64)]))
    stay = ~columns["gone"]
    ids = [columns["conv_id"][i] for i in new]
    of, roles, texts = of[stay], [r for r, s in zip(columns["role"], stay) if s], [t for t, s in zip(columns["text"], stay) if s]
    turn, known = columns["turn"][stay], columns["known"][stay]
    starts = np.searchsorted(of, np.arange(n + 1))

    core = [t.rstrip(BLANKS) for t in texts]
    blank = np.array([not c for c in core], bool)
    truncated = np.array([c[-1:] not in (".", "!", "?") for c in core], bool)
    seen: set = set()
    repeated = np.zeros(len(of), bool)
    for i in range(n):
        seen.clear()
        for p in range(starts[i], starts[i + 1]):
            before = len(seen)
            seen.add((roles[p], texts[p]))
            repeated[p] = len(seen) == before
    repeated &= ~blank
    truncated &= ~(blank | repeated)
    initial = np.array([r[:1] for r in roles], "U1")
    inside = of[1:] == of[:-1]
    legal = np.isin(np.char.add(initial[:-1], initial[1:]), ["su", "ua", "au"]) if len(of) else np.zeros(0, bool)

    cost, optimal = cheapest(starts, initial, blank | repeated, truncated)
    conversation, node, letter = least_audits(starts, optimal)
    cuts = np.searchsorted(conversation, np.arange(n + 1))
    names = KEEP + REROLE + DELETE + INSERT
    rows, states = node // 4 - conversation, node % 4
    audits, hashes = [], []
    for i in range(n):
        said, parts = [], []
        for row, state, move in zip(rows[cuts[i] : cuts[i + 1]].tolist(), states[cuts[i] : cuts[i + 1]].tolist(), letter[cuts[i] : cuts[i + 1]].tolist()):
            said.append(names[move])
            if move == 0:
                parts.append(f"{roles[row]}:{texts[row]}")
            elif move != 2:
                parts.append(f"{_ROLE[int(_NEXT[state])]}:{texts[row] if move == 1 else ''}")
        audits.append("".join(said))
        hashes.append(hashlib.sha256("\n".join(parts).encode()).hexdigest())

    # turns that are missing between the first and the last; equal turns stand together
    fresh = known & np.concatenate([[True], (of[1:] != of[:-1]) | (turn[1:] != turn[:-1]) | ~known[:-1]])[: len(of)]
    distinct = np.bincount(of[fresh], minlength=n)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low[of[fresh][::-1]], high[of[fresh]] = turn[fresh][::-1], turn[fresh]
    gaps = np.where(distinct > 0, high - low + 1 - distinct, 0)

    def count(flag: np.ndarray, where: np.ndarray = of) -> np.ndarray:
        return np.bincount(where[flag], minlength=n)

    return pa.RecordBatch.from_pydict(
        {
            "conv_id": pa.array(ids, pa.int64()),
            "gaps": gaps,
            "blank": count(blank),
            "duplicate": count(repeated),
            "truncated": count(truncated),
            "illegal": count(inside & ~legal, of[1:]),
            "cost": cost[(starts[:-1] + np.arange(n)) * 4 + NONE],
            "audit": audits,
            "repaired_sha256": hashes,
        }
    )


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole conversations from sorted rows."""
    waiting: list[pa.Table] = []

    def done(table: pa.Table) -> pa.RecordBatch:
        ids = table["conv_id"]
        turn = table["turn"]
        columns = {
            "conv_id": ids.to_pylist(),
            "turn": turn.fill_null(0).to_numpy(),
            "known": turn.is_valid().to_numpy(zero_copy_only=False),
            "role": table["role"].to_pylist(),
            "text": table["text"].to_pylist(),
            "gone": table["gone"].to_numpy(zero_copy_only=False),
        }
        return _block(_numbers(ids), columns)

    for batch in batches:
        for piece in cut(batch, TOGETHER):
            if not piece.num_rows:
                continue
            waiting.append(pa.Table.from_batches([piece]))
            if sum(t.num_rows for t in waiting) < ROWS and sum(t.nbytes for t in waiting) < TOGETHER:
                continue
            table = pa.concat_tables(waiting)
            number = _numbers(table["conv_id"])
            last = int(np.searchsorted(number, number[-1]))  # the last conversation may go on
            if last:
                yield done(table.slice(0, last))
            waiting = [table.slice(last)]
    if waiting:
        yield done(pa.concat_tables(waiting))


def _numbers(ids: pa.ChunkedArray) -> np.ndarray:
    """0, 1, 2, ... for runs of equal ids; null is an id."""
    known, value = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    return np.cumsum(np.concatenate([[0], ((value[1:] != value[:-1]) | (known[1:] != known[:-1])).astype(np.int64)]))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation with its faults, the cost and audit of its cheapest repair, and the repaired hash.

    ``rows`` come from ``damaged`` or ``untouched``: ``conv_id, turn, role, text, gone``.  They are taken by turn,
    nulls first, then by role and text.  Null ids are one conversation.  Repeated rows are duplicates; a
    conversation whose rows are all gone has zeros, an empty audit and the hash of the empty text; an empty
    table gives no rows.  One task holds a block of conversations; a conversation longer than a block (65,536 rows
    or 16 MB of text) is held whole, with about 500 bytes a row besides its text.
    """
    order = ["conv_id", "turn", "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).select(*order, "gone").mapInArrow(_repaired, _RESULT)


def oracle() -> str:
    """The SQL twin: from the last row to the first, the cheapest rest for each state with its audit and its rows."""

    def entry(cost: str, letter: str, line: str, rest: str) -> str:
        said = f"list_prepend({line}, {rest}.lines)" if line else f"{rest}.lines"
        return f"{{'cost': {rest}.cost + {cost}, 'audit': '{letter}' || {rest}.audit, 'lines': {said}}}"

    def least(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda o: o is not null))[1]"

    def keep(initial: str, rest: str) -> str:
        return f"case when first = '{initial}' and not gone then {entry('cut', 'K', chr(39) + chr(39) + ' || role || chr(58) || text', rest)} end"

    def rerole(role: str, rest: str) -> str:
        return f"case when not gone then {entry('2 + cut', 'R', f'{chr(39)}{role}:{chr(39)} || text', rest)} end"

    def insert(role: str, rest: str) -> str:
        return entry("2", "I", f"'{role}:'", rest)

    def delete(rest: str) -> str:
        return entry("3", "D", "", rest)

    over = "{'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]}"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    return rf"""
with recursive damaged as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("key")} % 20 as case_
  from (select *, {key} as key from conversations)
), rows_ as (
  select conv_id, turn, case when case_ = 4 then 'user' else role end as role,
         case case_ when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(case when case_ = 3 then [1, 2] else [1] end) as time
  from damaged where case_ <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, time) as p,
         rtrim(text, {blanks}) as core, row_number() over (partition by conv_id, role, text order by turn nulls first, time) as copy from rows_
), judged as (
  select *, core = '' as blank, core <> '' and copy > 1 as duplicate, core <> '' and copy = 1 and right(core, 1) not in ('.', '!', '?') as truncated,
         left(role, 1) as first, lag(left(role, 1)) over (partition by conv_id order by p) as before from placed
), counted as (
  select conv_id, count(*) as n, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (where blank) as blank,
         count(*) filter (where duplicate) as duplicate, count(*) filter (where truncated) as truncated,
         count(*) filter (where before is not null and before || first not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id
), ids as (select distinct conv_id from conversations),
path as (
  select ids.conv_id, coalesce(n, 0) as p, {over} as none, {entry("4", "II", "'user:'", f"({entry('0', '', chr(39) + 'assistant:' + chr(39), over)})")} as system,
         {entry("2", "I", "'assistant:'", f"({over})")} as user_, {over} as assistant
  from ids left join counted on counted.conv_id is not distinct from ids.conv_id
  union all
  select conv_id, p - 1, {least("none", insert("user", "least_user"))}, {least("system", insert("user", "least_user"))}, least_user, {least("assistant", insert("user", "user_"))}
  from (
    select *, {least("user_", insert("assistant", "assistant"))} as least_user
    from (
      select path.conv_id, path.p,
             {least(keep("s", "path.system"), keep("u", "path.user_"), rerole("user", "path.user_"), delete("path.none"))} as none,
             {least(keep("u", "path.user_"), rerole("user", "path.user_"), delete("path.system"))} as system,
             {least(keep("a", "path.assistant"), rerole("assistant", "path.assistant"), delete("path.user_"))} as user_,
             {least(keep("u", "path.user_"), rerole("user", "path.user_"), delete("path.assistant"))} as assistant
      from path join (select conv_id, p, role, text, first, blank or duplicate as gone, truncated::bigint as cut from judged) as j
        on j.conv_id is not distinct from path.conv_id and j.p = path.p
    )
  )
)
select path.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, none.cost as cost, none.audit as audit, sha256(array_to_string(none.lines, chr(10))) as repaired_sha256
from path left join counted on counted.conv_id is not distinct from path.conv_id where path.p = 0
"""
