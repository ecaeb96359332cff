"""Repair of conversations by Wagner-Fischer alignment with the roles that a dialogue may have.

Role initials of a repaired conversation match (s?(ua)+)?, so its targets are the last r symbols of ...uaua, and
the same with s before an even number of them. As every target of one kind is the end of a longer one, one
table holds all feasible lengths: its cell (i, r) is the cheapest way from rows i.. to the last r symbols. Only the
diagonals that a path of the incumbent's cost can reach are filled (Ukkonen): the incumbent is the cheaper of a
greedy repair in one pass and of deleting all. The table's rows are made backwards, each with a running minimum for
insertions, for all conversations of one row count at once. Then the edits of each length that reaches the
least cost are read off forwards, least letter first, and the least of these audits is kept.

Conversations of more than ``LONG_ROWS`` rows are rare, and a table for all lengths grows with the square of the
rows. There the columns of equal parity are folded into one, which loses nothing as only the least cost
over all lengths is asked for; a task streams over the rows twice and holds some fifty bytes a row and no
text. (The digest of a conversation and its audit, one cell, are sequential by their definition.)

Rows meet by conversation in one shuffle, sorted by turn (nulls first), then role, text; a whole short conversation
is at most ``LONG_ROWS`` rows. Everything that looks at one row alone happens in Spark expressions before.

Defined results: nulls in role and text count as one space, also in the damage key; rows of a null id are one
conversation; repeated rows are duplicates of each other; a row whose role has no initial can't be kept; gaps count
turns as longs; other columns are left out, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LONG_ROWS = 2048
#: Rows (and KiB of text) that are gathered before conversations are aligned together, and cells of a table.
ROWS_AT_ONCE, CELLS = 16384, 4_000_000
SPACE = " \t\n\x0b\f\r"
_FAR = 1 << 28
#: A row's code: its role's initial (0 other, 1 s, 2 u, 3 a), and flags.
S, U, A, MUST_GO, CUT_SHORT = 1, 2, 3, 4, 8
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def _folded(codes: list[int]) -> tuple[list[tuple[int, int, int, int]], str]:
    """Costs from each row on by what comes next, and the cheapest audit, least first.

    States: 0 nothing yet, 1 after s, 2 an assistant has to follow, 3 a pair is complete.
    """
    table = [(0, 2 * INSERT, INSERT, 0)]
    for code in reversed(codes):
        zero, after, half, full = table[-1]
        must, short, who = code & MUST_GO, TRUNCATED if code & CUT_SHORT else 0, code & 3
        user = _FAR if must else (KEEP if who == U else REROLE) + short + half
        pair = _FAR if must else (KEEP if who == A else REROLE) + short + full
        system = KEEP + short + after if who == S and not must else _FAR
        h, f = min(DELETE + half, pair), min(DELETE + full, user)
        h, f = min(h, INSERT + f), min(f, INSERT + h)
        table.append((min(DELETE + zero, user, system, INSERT + h), min(DELETE + after, user, INSERT + h), h, f))
    table.reverse()
    out, state = [], 0
    for i, code in enumerate(codes):
        must, short, who = code & MUST_GO, TRUNCATED if code & CUT_SHORT else 0, code & 3
        while True:
            now, then = table[i][state], table[i + 1]
            to = 3 if state == 2 else 2
            if DELETE + then[state] == now:
                out.append("D")
            elif INSERT + table[i][to] == now:
                out.append("I")
                state = to
                continue
            elif state == 0 and who == S and not must and KEEP + short + then[1] == now:
                out.append("K")
                state = 1
            else:
                out.append("K" if who == (A if state == 2 else U) else "R")
                state = to
            break
    out.append("I" * ((0, 2, 1, 0)[state]))
    return table, "".join(out)


def _incumbents(codes: np.ndarray) -> np.ndarray:
    """Cost of some repair of each conversation: greedy in one pass, or deleting all."""
    rows, n = codes.shape
    state, cost = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in range(n):
        code = codes[:, i]
        who, gone = code & 3, code & MUST_GO != 0
        wanted = np.where(state == 2, A, U)
        lead = (state == 0) & (who == S) & ~gone
        fits = (who == wanted) & ~gone
        ahead = (who == np.where(state == 2, U, A)) & ~gone  # the other one: insert what is wanted before it
        cost += np.where(gone, DELETE, np.where(lead | fits, KEEP, np.where(ahead, INSERT, REROLE))) + np.where((code & CUT_SHORT != 0) & ~gone, TRUNCATED, 0)
        flip = np.where(state == 2, 3, 2)
        state = np.where(gone, state, np.where(lead, 1, np.where(ahead, np.where(flip == 2, 3, 2), flip)))
    cost += np.where(state == 2, INSERT, np.where(state == 1, 2 * INSERT, 0))
    return np.minimum(cost, DELETE * n)


def _aligned(codes: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Least cost and least audit of each row of ``codes``, a matrix of conversations of one row count."""
    many, n = codes.shape
    if not n:
        return np.zeros(many, np.int64), [""] * many
    bound = int(_incumbents(codes).max())
    low, high = bound // DELETE, bound // INSERT
    width = low + high + 1
    diagonal = np.arange(-low, high + 1)  # symbols left over rows left
    slope = INSERT * np.arange(width)
    plain = np.full((n + 1, many, width + 1), _FAR, np.int32)  # one column more, so that deletions stay inside
    headed = np.full((n + 1, many, width + 1), _FAR, np.int32)
    plain[n, :, :width] = np.where(diagonal >= 0, INSERT * diagonal, _FAR)
    for i in range(n - 1, -1, -1):
        code = codes[:, i, None]
        left = diagonal + (n - i)
        must, short, who = code & MUST_GO != 0, np.where(code & CUT_SHORT != 0, TRUNCATED, 0), code & 3
        symbol = np.where(left % 2 == 0, U, A)
        take = plain[i + 1, :, :width] + short
        cell = np.minimum(plain[i + 1, :, 1:] + DELETE, np.where(must | (left < 1), _FAR, take + np.where(who == symbol, KEEP, REROLE)))
        cell = np.where(left < 0, _FAR, cell)
        plain[i, :, :width] = np.minimum(np.minimum.accumulate(cell - slope, axis=1) + slope, _FAR)
        lead = np.where(~must & (who == S) & (left % 2 == 1) & (left >= 3), take + KEEP, _FAR)
        headed[i, :, :width] = np.minimum(np.minimum(headed[i + 1, :, 1:] + DELETE, lead), _FAR)
    # every length that reaches the least cost: (conversation, diagonal, begins with s)
    left = diagonal + n
    ends = np.stack((np.where((left >= 0) & (left % 2 == 0), plain[0, :, :width], _FAR), np.where((left >= 3) & (left % 2 == 1), headed[0, :, :width], _FAR)), 1)
    cost = ends.min((1, 2))
    of, first, k = np.nonzero(ends == cost[:, None, None])
    first = first == 1
    at = np.zeros(len(of), np.int64)
    letters = np.zeros((len(of), n + width), np.uint8)
    live, step = np.arange(len(of)), 0
    while len(live):
        b, i, d, head = of[live], at[live], k[live], first[live]
        inside = i < n
        row = np.minimum(i, n - 1)
        code, below = codes[b, row], np.minimum(i + 1, n)
        r = d - low + n - i
        now = np.where(head, headed[i, b, d], plain[i, b, d])
        drop = inside & (np.where(head, headed[below, b, d + 1], plain[below, b, d + 1]) + DELETE == now)
        put = ~drop & ~head & (r >= 1) & (d >= 1) & (plain[i, b, d - 1] + INSERT == now)
        keep = ~drop & ~put & np.where(head, True, code & 3 == np.where(r % 2 == 0, U, A))
        letters[live, step] = np.where(drop, ord("D"), np.where(put, ord("I"), np.where(keep, ord("K"), ord("R"))))
        k[live] = np.where(drop, d + 1, np.where(put, d - 1, d))
        at[live] = np.where(put, i, i + 1)
        first[live] = head & drop
        step += 1
        live = live[(at[live] < n) | (k[live] - low > 0)]
    audits = [bytes(x).rstrip(b"\0").decode() for x in letters]
    out = [""] * many
    for b, audit in zip(of.tolist(), audits):
        if not out[b] or audit < out[b]:
            out[b] = audit
    return cost.astype(np.int64), out


def align(conversations: list[np.ndarray]) -> tuple[list[int], list[str]]:
    """Cost and audit of each conversation, given its rows' codes."""
    cost, audit = [0] * len(conversations), [""] * len(conversations)
    size = np.array([len(c) for c in conversations], np.int64)
    for n in np.unique(size).tolist():
        which = np.flatnonzero(size == n)
        each = max(1, CELLS // (2 * (n + 1) * (7 * n + 2)))
        for k in range(0, len(which), each):
            part = which[k : k + each].tolist()
            c, a = _aligned(np.stack([conversations[j] for j in part]))
            for j, x, y in zip(part, c.tolist(), a):
                cost[j], audit[j] = x, y
    return cost, audit


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn that is left or put in."""
    last = ""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        yield role, text


class _Counts:
    """Faults of a conversation, row by row."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.turn = None
        self.turns, self.last = 0, None
        self.codes = bytearray()

    def add(self, turn: int | None, role: str, blank: bool, seen: bool, ended: bool) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        code = {"s": S, "u": U, "a": A}.get(initial, 0)
        if blank:
            self.blank += 1
            code |= MUST_GO
        elif seen:
            self.duplicate += 1
            code |= MUST_GO
        elif not ended:
            self.truncated += 1
            code |= CUT_SHORT
        self.codes.append(code)

    def row(self) -> tuple[int, ...]:
        return (0 if self.least is None else self.most - self.least + 1 - self.turns, self.blank, self.duplicate, self.truncated, self.illegal)


def prepared(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, gone: Column | None = None) -> DataFrame:
    """conv, turn, role, text, and of each row: gone, bare (nothing but white space), ended (its last character but white space is a mark)."""
    rows = df.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        (F.lit(False) if gone is None else gone).alias("gone"),
    )
    said = F.rtrim("text", F.lit(SPACE))
    return rows.withColumns({"bare": said == "", "ended": F.right(said, F.lit(1)).isin(".", "!", "?")})


def repair(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """One row a conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired, repaired_sha256.

    ``repaired``: role:text of the turns, newline-joined; null for conversations of more than ``LONG_ROWS`` rows,
    of which only the digest is made. Rows that ``gone`` marks take no part but for their conversation's id.
    """
    rows = prepared(df, id_col, turn_col, role_col, text_col, gone)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"conv {kind}, {_COUNTS}, cost long, audit string, repaired string, repaired_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, _Counts, list[tuple[str, str]]]] = []
        seen: set[tuple[str, str]] = set()
        of_type = None

        def out() -> pa.RecordBatch:
            cost, audit = align([np.frombuffer(bytes(c.codes), np.uint8).astype(np.int64) for _, c, _ in held])
            text = ["\n".join(f"{r}:{t}" for r, t in repaired(iter(lines), a)) for (_, _, lines), a in zip(held, audit)]
            digest = [hashlib.sha256(t.encode()).hexdigest() for t in text]
            counts = np.array([c.row() for _, c, _ in held], np.int64).T
            columns = [pa.array([conv for conv, _, _ in held], of_type), *(pa.array(c) for c in counts), pa.array(cost, pa.int64()), pa.array(audit), pa.array(text), pa.array(digest)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        n = 0
        for batch in batches:
            of_type = batch.schema.field(0).type
            for conv, turn, role, text, gone, bare, ended in zip(*(c.to_pylist() for c in batch.columns)):
                if not held or held[-1][0] != conv:
                    if n >= ROWS_AT_ONCE:
                        yield out()
                        held.clear()
                        n = 0
                    held.append((conv, _Counts(), []))
                    seen.clear()
                n += 1 + len(text) // 1024
                if not gone:
                    held[-1][1].add(turn, role, bare, (role, text) in seen, ended)
                    seen.add((role, text))
                    held[-1][2].append((role, text))
        if held:
            yield out()

    long = stored(rows.groupBy("conv").count().where(F.col("count") > LONG_ROWS).select(F.col("conv").alias("long")), "long-conversations")
    some, same = not long.isEmpty(), F.col("conv").eqNullSafe(F.col("long"))
    order = [F.asc_nulls_first("turn"), "role", "text"]
    together = (rows.join(long, same, "left_anti") if some else rows).repartition("conv").sortWithinPartitions("conv", *order)
    found = together.mapInArrow(short, schema)
    if some:
        found = found.unionByName(_long(stored(rows.join(long, same, "left_semi"), "long-rows"), schema, names))
    return found.withColumnRenamed("conv", id_col)


def _long(rows: DataFrame, schema: str, names: list[str]) -> DataFrame:
    """The same of long conversations, streamed: first the codes and the audit, then the digest, after the audit."""
    kind = rows.schema["conv"].dataType.simpleString()

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[object, _Counts] | None = None
        seen: set[bytes] = set()
        of_type = None

        def out() -> pa.RecordBatch:
            conv, counts = held
            table, audit = _folded(list(counts.codes))
            return pa.RecordBatch.from_arrays([pa.array([conv], of_type), *(pa.array([x]) for x in counts.row()), pa.array([table[0][0]]), pa.array([audit])], names=names[:8])

        for batch in batches:
            of_type = batch.schema.field(0).type
            for conv, turn, role, text, gone, bare, ended in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held[0] != conv:
                    if held:
                        yield out()
                    held = (conv, _Counts())
                    seen.clear()
                if not gone:
                    key = hashlib.blake2b(f"{role}\0{text}".encode(), digest_size=16).digest()
                    held[1].add(turn, role, bare, key in seen, ended)
                    seen.add(key)
        if held:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, letters, last, some, of_type = None, None, None, "", False, None

        def say(role: str, text: str) -> None:
            nonlocal last, some
            digest.update((b"\n" if some else b"") + f"{role}:{text}".encode())
            last, some = role[:1], True

        def insert() -> str | None:
            """Turns put in before the next row; the next row's letter."""
            while (letter := next(letters, None)) == "I":
                say("assistant" if last == "u" else "user", "")
            return letter

        def out() -> pa.RecordBatch:
            insert()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], of_type), *(pa.array([x]) for x in now[1:]), pa.array([None], pa.string()), pa.array([digest.hexdigest()])], names=names)

        for batch in batches:
            of_type = batch.schema.field("conv").type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                conv, role, text, gone, counts = row[0], row[2], row[3], row[4], row[7:]
                if counts[-1] is not None:  # the audit, which comes first
                    if now:
                        yield out()
                    now, digest, letters, last, some = (conv, *counts), hashlib.sha256(), iter(counts[-1]), "", False
                elif not gone and (letter := insert()) != "D":
                    say(role if letter == "K" else "assistant" if last == "u" else "user", text)
        if now:
            yield out()

    order = [F.asc_nulls_first("turn"), "role", "text"]
    own = rows.repartition("conv").sortWithinPartitions("conv", *order)
    first = own.mapInArrow(audits, f"conv {kind}, {_COUNTS}, cost long, audit string")
    both = rows.unionByName(first, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), *order)
    return both.select(*rows.columns, *names[1:8]).mapInArrow(digests, schema)


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with the faults that the query asks for; ``gone`` marks dropped rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("fault"))
    fault = F.col("fault")
    said = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (fault == 0).alias("gone"), copies.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: counts, least cost, audit and digest of every conversation's repair, after damage."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damaged(table), gone=F.col("gone"))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _oracle() -> str:
    """The folded recurrence in SQL: rows from last to first, each state's cost (nine digits) and audit as one string, whose order is that of both."""
    add = lambda cost, letter, then: f"(lpad((left({then}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({then}, 10))"
    must, short = "r.fault IN ('b', 'd')", "(CASE WHEN r.fault = 't' THEN 3 ELSE 0 END)"
    never = "'999999999'"
    take = lambda who, then: f"CASE WHEN {must} THEN {never} WHEN r.i = '{who}' THEN {add(short, 'K', then)} ELSE {add(f'3 + {short}', 'R', then)} END"
    system = f"CASE WHEN NOT {must} AND r.i = 's' THEN {add(short, 'K', 'w.y')} ELSE {never} END"
    return f"""
WITH RECURSIVE crc AS (
  SELECT key, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(key, '')])),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) AS c
  FROM (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
dm AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(c, 4294967295::BIGINT) % 20 AS f
  FROM conversations JOIN crc ON key = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, f,
    unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM dm),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS same FROM d WHERE f <> 0),
r AS (SELECT conv_id, turn, role, text, k, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before, count(*) OVER (PARTITION BY conv_id) AS n,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN same > 1 THEN 'd' WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'f' ELSE 't' END AS fault FROM o),
w AS (SELECT conv_id, max(n) AS k, '000000000' AS z, '000000006II' AS y, '000000003I' AS h, '000000000' AS f FROM r GROUP BY conv_id
  UNION ALL
  SELECT conv_id, k, least(z0, {add(3, "I", "h2")}), least(y0, {add(3, "I", "h2")}), h2, f2 FROM (
    SELECT conv_id, k, z0, y0, least(h0, {add(3, "I", "f0")}) AS h2, least(f0, {add(3, "I", "h0")}) AS f2 FROM (
      SELECT w.conv_id, w.k - 1 AS k, least({add(4, "D", "w.z")}, {take("u", "w.h")}, {system}) AS z0, least({add(4, "D", "w.y")}, {take("u", "w.h")}) AS y0,
        least({add(4, "D", "w.h")}, {take("a", "w.f")}) AS h0, least({add(4, "D", "w.f")}, {take("u", "w.h")}) AS f0
      FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k))),
best AS (SELECT conv_id, left(z, 9)::BIGINT AS cost, substr(z, 10) AS audit FROM w WHERE k = 0),
e AS (SELECT conv_id, j, substr(audit, j, 1) AS op, (length(replace(left(audit, j), 'I', '')))::BIGINT AS k, length(replace(left(audit, j), 'D', '')) AS place, audit FROM best, unnest(range(1, length(audit) + 1)) AS t(j)),
l AS (SELECT e.conv_id, e.place, CASE WHEN e.op = 'K' THEN r.role WHEN (e.place + (CASE WHEN s.i = 's' THEN 1 ELSE 0 END)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e.op = 'I' THEN '' ELSE r.text END AS line
  FROM e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.k = e.k AND e.op <> 'I'
  LEFT JOIN (SELECT e.conv_id, r.i FROM e JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.k = e.k WHERE e.op = 'K' AND e.place = 1) s ON s.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.op <> 'D'),
t AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS digest FROM l GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""


ORACLE = _oracle()
