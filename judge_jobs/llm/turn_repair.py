"""Repair of conversations by weighted interval parsing.

A conversation is in order if its roles read as an optional system turn and then pairs of user and assistant turns, or if it is
empty. The cheapest edits are found by a CYK parse with a grammar in Chomsky normal form. A nonterminal (p, q)
stands for edited turns that take the pattern from state p to state q, so the binary rules are
(p, q) -> (p, r) (r, q), the terminal rules are the edits of one turn, and insertions close each terminal cell
on both sides. A cell holds for each nonterminal the least cost and, among equal costs, the ASCII-least audit
(the edits' initials). Two audits of one cell and cost are never prefixes of each other, since the one
would hold only insertions more and so cost more; so the least of a cell stays the least in whatever it is joined to.

With these rules every split of a span gives the same cell, so spans are combined bottom-up by length, 1, 2, 4 and so on,
one split for each. A conversation of any length thus falls into blocks that tasks parse on their own: rows are
range-partitioned by conversation and turn, only narrow rows move, and the blocks' cells are combined after.
"""

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, sized_partitions, table

#: White space, which neither fills a turn nor ends its last sentence.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of one conversation that are parsed as one block at most (bounds memory, not results).
BLOCK = 512
#: Characters of a text that order rows of one turn and role; a hash decides between equal ones.
HEAD = 32

#: States of the pattern s?(ua)+: at its start, after the system turn, after a user's, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: An empty result is in order too.
ACCEPTED = ((START, START), (START, ASSISTANT))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1


def joined(left: dict, right: dict) -> dict:
    """The cell of two neighbouring spans: (p, q) -> (p, r) (r, q)."""
    out: dict = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            found = right.get((r, q))
            if found:
                both = (cost + found[0], audit + found[1])
                if (p, q) not in out or both < out[p, q]:
                    out[p, q] = both
    return out


def _inserted() -> dict:
    """What insertions alone do: any number of them, of which more than two never pay."""
    once = {(p, q): (INSERT, "I") for role in "ua" for p, q in MOVES[role].items()}
    cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(2):
        for key, value in joined(cell, once).items():
            cell[key] = min(value, cell.get(key, value))
    return cell


INSERTED = _inserted()
_cells: dict = {}


def turn_cell(initial: str, unwanted: bool, truncated: bool) -> dict:
    """The cell of one turn, closed under insertions. ``unwanted`` turns can only be deleted."""
    key = initial, unwanted, truncated
    if key not in _cells:
        cell = {(p, p): (DELETE, "D") for p in range(4)}
        if not unwanted:
            for p, q in MOVES.get(initial, {}).items():
                cell[p, q] = (KEEP + TRUNCATED * truncated, "K")
            for role in "ua":
                for p, q in MOVES[role].items():
                    edit = (REROLE + TRUNCATED * truncated, "R")
                    cell[p, q] = min(edit, cell.get((p, q), edit))
        _cells[key] = joined(joined(INSERTED, cell), INSERTED)
    return _cells[key]


def parse(cells: list) -> dict:
    """The cell of a whole span of neighbouring cells, combined by span length."""
    while len(cells) > 1:
        pairs = [joined(cells[k], cells[k + 1]) for k in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[len(cells) - len(cells) % 2 :]
    return cells[0] if cells else INSERTED


def clean(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text of a table with any names; null role and text become one space."""
    c = lambda name: conversations[f"`{name}`"]
    return conversations.select(c(conv_col).cast("long").alias("conv_id"), c(turn_col).cast("long").alias("turn"), F.coalesce(c(role_col), F.lit(" ")).alias("role"), F.coalesce(c(text_col), F.lit(" ")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults put into the rows of :func:`clean` by the crc32 of ``conv_id:turn`` (null: one space) modulo 20.

    0 drops a row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it a user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.withColumn("kind", kind).where("kind <> 0").withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


#: One conversation's turn of one role and text, wherever it stands.
KEY = "unhex(md5(concat(coalesce(cast(conv_id as string), ''), ':', length(role), ':', role, text)))"
COUNTS = "n long, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, from_turn long, to_turn long, from_initial string, to_initial string"
BLOCKS = f"conv_id long, part int, block long, {COUNTS}, initials string, keys array<binary>, cell array<struct<p:int,q:int,cost:long,audit:string>>"


def blocks(rows: DataFrame) -> DataFrame:
    """The rows of :func:`clean` as parsed blocks: counts of faults, keys in order, and the cell."""
    n = sized_partitions(rows.sparkSession)
    end = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select("conv_id", "turn", "role", F.substring("text", 1, HEAD).alias("head"), F.expr(KEY).alias("key"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    marked = table(narrow, "marked")
    repeats = marked.groupBy("key").agg(F.count("*").alias("times"), F.max(F.col("turn").isNull()).alias("from_null"), F.min("turn").alias("first")).where("times > 1")
    # rows of the first turn are compared with their neighbours in order
    later = F.when(F.col("from_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") != F.col("first"))
    flagged = marked.join(repeats, "key", "left").select("conv_id", "turn", "role", "head", "key", "blank", "cut", F.coalesce(later, F.lit(False)).alias("later"))
    order = ["conv_id", "turn", "role", "head", "key"]
    ordered = flagged.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "key", F.substring("role", 1, 1).alias("initial"), "blank", "cut", "later")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int64()] * 10, pa.string(), pa.string(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]
        names = ["conv_id", "part", "block", *[x.split()[0] for x in COUNTS.split(", ")], "initials", "keys", "cell"]

        def summed(conv, rows):
            """One block; ``rows``: turn, key, initial, fault."""
            turns = [r[0] for r in rows if r[0] is not None]
            faults = [r[3] for r in rows]
            initials = "".join(r[2] for r in rows)
            cell = parse([turn_cell(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            distinct = sum(k == 0 or turns[k - 1] != t for k, t in enumerate(turns))
            ends = (turns[0], turns[-1]) if turns else (None, None)
            return [conv, part, number, len(rows), *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, distinct, *ends, *ends, initials[0], initials[-1], initials, [r[1] for r in rows], [(p, q, *x) for (p, q), x in cell.items()]]

        now, rows, out, last = None, [], [], None
        for batch in batches:
            for conv, turn, key, initial, blank, cut, later in zip(*[batch.column(k).to_pylist() for k in range(7)]):
                if rows and (conv != now or len(rows) >= BLOCK):
                    out.append(summed(now, rows))
                    number, rows = number + 1, []
                fault = "blank" if blank else "duplicate" if later or key == last else "truncated" if cut else ""
                rows.append((turn, key, initial if initial in ("s", "u", "a") else "-", fault))
                now, last = conv, key
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if rows:
            out.append(summed(now, rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    found = table(ordered.mapInArrow(run, BLOCKS), "blocks")
    drop_table(marked)
    return found


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<part:int,block:long,system:boolean,rows:array<struct<at:long,letters:string>>>>"


def combined(parsed: DataFrame) -> DataFrame:
    """A row for each conversation of :func:`blocks`: counts, least cost and audit, and each block's rows with their edits.

    A conversation's audit is one value, so one task holds its (up to eleven) candidates.
    """

    def finish(conv, blocks):
        most = lambda name, f: f((b[name] for b in blocks if b[name] is not None), default=None)
        least, last = most("least", min), most("most", max)
        cell = parse([{(x["p"], x["q"]): (x["cost"], x["audit"]) for x in b["cell"]} for b in blocks])
        cost, audit = min(cell[k] for k in ACCEPTED if k in cell)
        distinct = sum(b["turns"] for b in blocks)
        illegal = sum(b["illegal"] for b in blocks)
        turn = None  # the last that isn't null
        for a, b in zip(blocks, blocks[1:]):
            turn = a["to_turn"] if a["to_turn"] is not None else turn
            distinct -= b["from_turn"] is not None and b["from_turn"] == turn
            illegal += a["to_initial"] + b["from_initial"] not in ("su", "ua", "au")
        gaps = 0 if least is None else last - least + 1 - distinct
        # each row's letter with the insertions before it, and how many turns of the result came before; the last insertions have no row
        parts, at, k, system = [], 0, 0, None
        for b in blocks:
            rows = []
            for initial in b["initials"]:
                begin = k
                while audit[k] == "I":
                    k += 1
                k += 1
                letters = audit[begin:k]
                if system is None and letters != "D":
                    system = letters == "K" and initial == "s"
                rows.append((at, letters))
                at += len(letters) - (letters[-1] == "D")
            if b is blocks[-1] and k < len(audit):
                rows.append((at, audit[k:]))
            parts.append((b["part"], b["block"], bool(system), rows))
        return [conv, gaps, *[sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated")], illegal, cost, audit, parts]

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in RESULT.split(", ")]
        edits = pa.list_(pa.struct([("at", pa.int64()), ("letters", pa.string())]))
        kinds = [*[pa.int64()] * 7, pa.string(), pa.list_(pa.struct([("part", pa.int32()), ("block", pa.int64()), ("system", pa.bool_()), ("rows", edits)]))]
        now, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv_id"] != now:
                    out.append(finish(now, held))
                    held = []
                now = row["conv_id"]
                held.append(row)
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if held:
            out.append(finish(now, held))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    order = ["conv_id", "part", "block"]
    dealt = parsed.drop("keys").repartition(sized_partitions(parsed.sparkSession), "conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, RESULT)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse and repair the rows of :func:`clean`: (a row for each conversation, its repaired rows).

    Rows go by turn (null first), then role, the first characters of the text, and its hash. A row's first fault counts: blank, duplicate
    (role and text seen earlier in the conversation), truncated (its last character that isn't space ends no sentence).
    First table: conv_id, gaps, the four counts, cost and audit. Second: conv_id, at (from 0), role, text, edit (K, R or I). Null
    conversations are one, repeated rows are duplicates, texts of any length move once for the result, an empty table gives empty ones.
    """
    parsed = blocks(rows)
    whole = table(combined(parsed), "parsed")
    shares = whole.select(F.inline("parts"))
    each = parsed.select("part", "block", "conv_id", "keys").join(shares, ["part", "block"])
    placed = each.select("conv_id", "system", F.explode(F.arrays_zip("rows", "keys")).alias("e")).select("conv_id", "system", "e.rows.at", "e.rows.letters", F.col("e.keys").alias("key"))
    inserts = F.length(F.regexp_extract("letters", "^I*", 0))
    role = lambda at: F.when((at - F.col("system").cast("long")) % 2 == 0, "user").otherwise("assistant")
    added = placed.where(inserts > 0).select("conv_id", "system", F.explode(F.sequence(F.col("at"), F.col("at") + inserts - 1)).alias("at"))
    added = added.select("conv_id", "at", role(F.col("at")).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    stays = placed.select("key", (F.col("at") + inserts).alias("at"), F.right("letters", F.lit(1)).alias("edit"), "system").where("edit in ('K', 'R')")
    # a turn that stays is the first of its role and text in its conversation
    texts = rows.withColumn("key", F.expr(KEY)).groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.first("role").alias("own"), F.first("text").alias("text"))
    kept = texts.join(stays, "key").select("conv_id", "at", F.when(F.col("edit") == "K", F.col("own")).otherwise(role(F.col("at"))).alias("role"), "text", "edit")
    return whole.drop("parts"), kept.unionByName(added)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the newline-joined ``role:text`` lines of each conversation, read as a stream in order."""

    def run(batches):
        import pyarrow as pa

        now, digest, out = None, None, []
        for batch in batches:
            for conv, role, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                line = f"{role}:{text}".encode()
                if digest and conv == now:
                    digest.update(b"\n" + line)
                else:
                    if digest:
                        out.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256(line)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
            out = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    dealt = repaired.repartition(sized_partitions(repaired.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conversation of the first table about its rows in the second: counts, cost, audit, repaired_sha256."""
    whole, repaired = repair(rows)
    every = conversations.select("conv_id").distinct()
    on = lambda other: every["conv_id"].eqNullSafe(other["conv_id"])
    hashed = digests(repaired)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    both = every.join(whole, on(whole), "left").join(hashed, on(hashed), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return both.select(every["conv_id"], *[F.coalesce(whole[c], F.lit(0)).alias(c) for c in counts], F.coalesce(whole["audit"], F.lit("")).alias("audit"), F.coalesce(hashed["repaired_sha256"], F.lit(nothing)).alias("repaired_sha256"))
