"""Conversation structure repair.

Turns are put in order once, by a range partitioning that may cut anywhere, so a conversation of
any size is a row of chunks. A chunk is a string of symbols; distinct strings give a grammar that
all conversations share (``repair_grammar``), and chunks become products of its rules' matrices.
A conversation in one chunk is solved where it lies. Those that were cut are folded chunk by chunk
with four entries as state; each chunk then gets its part of the audit and is edited by itself.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import repair_grammar as G
from plumbline.llm.common import col, pin_batches
from plumbline.plans.small import written

CHUNK_TURNS, CHUNK_BYTES = 4096, 4 << 20
PAIRS_A_ROUND, MOST_RULES, LEAST_USES = 24, 240, 4
BLANKS = "\t\n\x0b\x0c\r "
ENDS = (".", "!", "?")
NAMES = {"u": "user", "a": "assistant"}
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def turns_in_order(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """``(conv, turn, role, h, k, text)`` in ranges, sorted: equal rows once, the text with the first of its kind.

    A row of kind 0 says that ``k`` equal turns stand here; one of kind 1, directly behind it, that
    they are the first with this role and text, and brings the text. Blank turns have no kind 1.
    """
    k = F.lit(1).cast("long") if copies is None else F.coalesce(col(copies), F.lit(0)).cast("long")
    there = k > 0
    base = rows.select(
        col(conv).alias("conv"),
        F.when(there, col(turn).cast("long")).alias("turn"),
        F.when(there, F.coalesce(col(role).cast("string"), F.lit(" "))).alias("role"),
        F.when(there, F.coalesce(col(text).cast("string"), F.lit(" "))).alias("text"),
        k.alias("k"),
    )
    base = base.withColumn("blank", F.rtrim("text", F.lit(BLANKS)) == "").withColumn(
        "h", F.unhex(F.sha2(F.when(~F.col("blank"), F.col("text")).cast("binary"), 256))
    )
    # Texts take part in neither grouping; the first of a kind keeps its own.
    every = base.groupBy("conv", "turn", "role", "h").agg(F.sum("k").alias("k"))
    place = F.struct(F.col("turn").isNotNull().alias("later"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = base.where(there & ~F.col("blank")).groupBy("conv", "role", "h").agg(
        F.min(place).alias("place"), F.first("text").alias("text")
    )
    first = first.select(
        "conv", F.when(F.col("place.later"), F.col("place.turn")).alias("turn"), "role", "h", F.lit(1).alias("kind"),
        F.lit(0).cast("long").alias("k"), "text",
    )
    every = every.select("conv", "turn", "role", "h", F.lit(0).alias("kind"), "k", F.lit(None).cast("string").alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "h")]
    return every.unionByName(first).repartitionByRange(*order).sortWithinPartitions(*order, "kind")


class Chunk:
    """Consecutive turns of one conversation."""

    def __init__(self, conv, opens: bool):
        self.conv, self.opens = conv, opens
        self.symbols, self.kept = [], []
        self.n = self.bytes = 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first = self.last = None  # initials
        self.low = self.high = None
        self.turns = 0

    def see(self, turn):
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1

    def add(self, turn, role: str, symbol: str, fault: str | None, n: int = 1, text: str | None = None):
        """``n`` equal turns."""
        initial = role[:1]
        self.see(turn)
        pairs = ([self.last + initial] if self.last is not None else []) + [initial * 2] * min(n - 1, 1)
        times = [1] * (self.last is not None) + [n - 1] * min(n - 1, 1)
        self.counts["illegal"] += sum(t for p, t in zip(pairs, times) if p not in ("su", "ua", "au"))
        self.first = initial if self.first is None else self.first
        self.last = initial
        self.symbols.append(symbol * n)
        self.n += n
        if fault:
            self.counts[fault] += n
        if text is not None:
            self.kept.append({"role": role, "text": text})
            self.bytes += len(text)

    def row(self, id: int, whole: bool) -> dict:
        return {
            "chunk": id, "conv": self.conv, "whole": whole, "symbols": "".join(self.symbols), "kept": self.kept,
            **self.counts, "first": self.first, "last": self.last, "low": self.low, "high": self.high, "turns": self.turns,
        }


CHUNK_FIELDS = (
    "chunk long, conv {conv}, whole boolean, symbols string, kept array<struct<role: string, text: string>>, "
    "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
)


def chunked(turns: DataFrame, chunk_turns: int, chunk_bytes: int) -> DataFrame:
    """Chunks of the turns in order; ``whole`` if a chunk is sure to be a conversation."""
    schema = T.StructType.fromDDL(CHUNK_FIELDS.format(conv="string"))
    schema["conv"].dataType = turns.schema["conv"].dataType

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, id = to_arrow_schema(schema), TaskContext.get().partitionId() << 32
        now, held, out, size, first_conv = None, None, [], 0, True

        def close(whole):
            nonlocal id, size
            out.append(now.row(id, whole))
            id, size = id + 1, size + now.bytes + now.n

        def place(turn, role, h, k, text):
            """Equal turns: the first of its kind with its text, all others must go."""
            nonlocal now
            kind = "blank" if h is None else "duplicate"
            if text is not None:
                unended = not text.rstrip(BLANKS).endswith(ENDS)
                now.add(turn, role, G.symbol(role[:1], unended), "truncated" if unended else None, 1, text)
                k -= 1
            while k > 0:
                some = min(k, max(chunk_turns - now.n, 1))
                now.add(turn, role, G.MUST_GO, kind, some)
                k -= some
                if k:
                    close(False)
                    now = Chunk(now.conv, False)

        def put(row, text):
            nonlocal now, first_conv
            conv, turn, role, h, k = row
            if now is None or conv != now.conv:
                if now is not None:
                    close(now.opens and not first_conv)
                    first_conv = False
                now = Chunk(conv, True)
            elif now.n >= chunk_turns or now.bytes >= chunk_bytes:
                close(False)
                now = Chunk(conv, False)
            if k:
                place(turn, role, h, k, text)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "h", "k", "kind", "text")]
            for conv, turn, role, h, k, kind, text in zip(*columns):
                if kind:
                    put(held, text)
                    held = None
                else:
                    if held is not None:
                        put(held, None)
                    held = conv, turn, role, h, k
                if size > chunk_bytes:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
        if held is not None:
            put(held, None)
        if now is not None:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return turns.mapInArrow(run, schema)


def grammar_of(chunks: DataFrame, most_rules: int = MOST_RULES) -> list[tuple[str, str]]:
    """Re-Pair rules of the distinct strings of symbols, some of the most frequent pairs a round.

    Each round counts all pairs left by the rules so far; only the most frequent ones, at most
    ``PAIRS_A_ROUND``, come to the driver. Rules make the work shorter, no result depends on them.
    """
    spark = chunks.sparkSession
    strings = written(chunks.select("symbols").where("symbols != ''").distinct(), "symbols")
    rules: list[tuple[str, str]] = []
    while len(rules) < most_rules:
        known = spark.sparkContext.broadcast(list(rules))

        def run(batches):
            grammar = None
            for batch in batches:
                grammar = grammar or G.Grammar(known.value)
                pairs, n = G.neighbours(grammar.compressed("\n".join(batch.column(0).to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

        counts = strings.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = counts.where(F.col("n") >= LEAST_USES).orderBy(F.desc("n"), "pair").limit(min(PAIRS_A_ROUND, most_rules - len(rules)))
        found = [(chr(r.pair >> 32), chr(r.pair & 0xFFFFFFFF)) for r in top.collect()]
        if not found:
            break
        rules += found
    return rules


_GRAMMARS: dict[tuple, G.Grammar] = {}


def grammar(rules: list[tuple[str, str]]) -> G.Grammar:
    """The rules' matrices, computed once a process."""
    key = tuple(rules)
    if key not in _GRAMMARS:
        _GRAMMARS.clear()
        _GRAMMARS[key] = G.Grammar(rules)
    return _GRAMMARS[key]


TURN = "struct<edit: string, role: string, text: string>"


def edited(kept: list[dict], symbols: str, audit: str, start: int) -> list[dict]:
    """What a part of the audit makes of a chunk: edit, role and text of each turn that is written."""
    stays = [i for i, c in enumerate(symbols) if c != G.MUST_GO]
    own = dict(zip(stays, kept))
    out = []
    for letter, at, initial in G.applied(audit, symbols, start)[0]:
        if letter == "I":
            out.append({"edit": letter, "role": NAMES[initial], "text": ""})
        elif letter != "D":
            turn = own[at]
            out.append({"edit": letter, "role": turn["role"] if letter == "K" else NAMES[initial], "text": turn["text"]})
    return out


def solved_whole(chunks: DataFrame, rules) -> DataFrame:
    """Conversations of one chunk: cost, audit and repaired turns."""
    names = [c for c in chunks.columns if c not in ("symbols", "kept")]
    schema = T.StructType([*(chunks.schema[c] for c in names), *T.StructType.fromDDL(f"cost long, audit string, turns_out array<{TURN}>")])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            solve = grammar(rules.value).solved
            strings = batch.column("symbols").to_pylist()
            found = [solve[s] for s in strings]
            turns = [edited(k, s, a, G.START) for k, s, (_, a) in zip(batch.column("kept").to_pylist(), strings, found)]
            columns = [*(batch.column(c) for c in names), *([c for c, _ in found], [a for _, a in found], turns)]
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow)], schema=arrow
            )

    return chunks.mapInArrow(run, schema)


def folded(chunks: DataFrame, rules) -> DataFrame:
    """Conversations that were cut: a row a chunk with its part of the audit and the state it starts in;
    a conversation's last chunk also has the sums, the cost and the whole audit."""
    kind = chunks.schema["conv"].dataType
    fields = "chunk long, start int, part string, ends boolean, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"
    schema = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL(fields)])
    narrow = chunks.drop("kept", "whole")
    dealt = narrow.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "chunk")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, state, conv, any_seen = to_arrow_schema(schema), None, None, False

        def fresh():
            return {"row": [(0, ""), None, None, None], "chunks": [], "counts": dict.fromkeys(COUNTS, 0), "last": None,
                    "low": None, "high": None, "turns": 0}

        def add(s, r):
            matrix = grammar(rules.value).matrix(r["symbols"])
            s["row"], origin = G.row_product(s["row"], matrix)
            s["chunks"].append((r["chunk"], len(r["symbols"]), origin))
            for c in COUNTS:
                s["counts"][c] += r[c]
            if r["first"] is not None:
                if s["last"] is not None and s["last"] + r["first"] not in ("su", "ua", "au"):
                    s["counts"]["illegal"] += 1
                s["last"] = r["last"]
            if r["low"] is not None:
                s["turns"] += r["turns"] - (s["high"] == r["low"])
                s["low"] = r["low"] if s["low"] is None else s["low"]
                s["high"] = r["high"]

        def done(conv, s):
            (cost, audit), state = G.finish(s["row"])
            audit, starts = G.flat(audit), []
            for _, _, origin in reversed(s["chunks"]):
                state = origin[state]
                starts.append(state)
            at, rows = 0, []
            for i, ((chunk, n, _), start) in enumerate(zip(s["chunks"], reversed(starts))):
                begin, ends = at, i == len(s["chunks"]) - 1
                while n and not ends:
                    n -= audit[at] != "I"
                    at += 1
                part = audit[begin:] if ends else audit[begin:at]
                rows.append({"conv": conv, "chunk": chunk, "start": start, "part": part, "ends": ends})
            rows[-1] |= {**s["counts"], "gaps": gaps(s["low"], s["high"], s["turns"]), "cost": cost, "audit": audit}
            return pa.RecordBatch.from_pylist(rows, arrow)

        for batch in batches:
            for r in batch.to_pylist():
                if any_seen and r["conv"] != conv:
                    yield done(conv, state)
                    any_seen = False
                if not any_seen:
                    conv, state, any_seen = r["conv"], fresh(), True
                add(state, r)
        if any_seen:
            yield done(conv, state)

    return dealt.mapInArrow(run, schema)


def gaps(low, high, turns) -> int:
    return 0 if low is None else high - low + 1 - turns


def parts_edited(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """``(conv, chunk, turns_out)`` of chunks with their parts of the audits."""
    kind = chunks.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL(f"chunk long, turns_out array<{TURN}>")])
    both = chunks.select("conv", "chunk", "symbols", "kept").join(parts.select("chunk", "start", "part"), "chunk")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = batch.to_pylist()
            out = [{"conv": r["conv"], "chunk": r["chunk"], "turns_out": edited(r["kept"], r["symbols"], r["part"], r["start"])} for r in rows]
            yield pa.RecordBatch.from_pylist(out, arrow)

    return both.select("conv", "chunk", "symbols", "kept", "start", "part").mapInArrow(run, schema)


def hashed_parts(parts: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)`` of repaired chunks, read in order: one hash is the state, however many turns."""
    kind = parts.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), T.StructField("repaired_sha256", T.StringType())])
    lines = F.array_join(F.transform("turns_out", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    rows = parts.select("conv", "chunk", F.when(F.size("turns_out") > 0, lines).alias("lines"))
    dealt = rows.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "chunk")

    def run(batches):
        conv, made, begun = None, None, False

        def row():
            names = [pa.array([conv], kind_arrow), pa.array([made.hexdigest()])]
            return pa.RecordBatch.from_arrays(names, names=["conv", "repaired_sha256"])

        for batch in batches:
            kind_arrow = batch.column(0).type
            for own, lines in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if made is not None and own != conv:
                    yield row()
                    made = None
                if made is None:
                    conv, made, begun = own, hashlib.sha256(), False
                if lines is not None:
                    made.update((b"\n" if begun else b"") + lines.encode())
                    begun = True
        if made is not None:
            yield row()

    return dealt.mapInArrow(run, schema)


class Repaired:
    """``conversations``: a row each, with counts, cost, audit and hash. ``turns``: what is written."""

    def __init__(self, conversations: DataFrame, turns: DataFrame):
        self.conversations, self.turns = conversations, turns


def repair(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    copies: str | None = None,
    chunk_turns: int = CHUNK_TURNS,
    chunk_bytes: int = CHUNK_BYTES,
    most_rules: int = MOST_RULES,
) -> Repaired:
    """The cheapest edits that make every conversation nothing, or an optional system turn and then
    user and assistant turns in pairs.

    Turns are taken by ``turn`` (a whole number, nulls first), those of one turn by role and a hash
    of the text. A turn without a character other than white space is blank; one whose role and
    text came before is a duplicate (SHA-256 tells texts apart); both must be deleted (4). One that
    does not end with ``. ! ?`` is truncated and costs 3 if it stays. Keep is free, another role
    (user or assistant) and an inserted empty turn cost 3. Of equally cheap audits the least in
    ASCII order counts. ``copies`` names a column that says how often a row counts; rows that count
    0 times only name their conversation.

    Null roles and texts are one space; a role without an initial of s, u or a cannot be kept. A null conversation is one conversation; repeated rows
    stand side by side, so all but one are duplicates. A conversation without turns has zeros, an
    empty audit and the hash of nothing; an empty table has no conversations. Other columns are not
    read. A conversation may hold any share of the rows, but its audit is one value, so it must
    stay below two billion characters. The order of turns is written to the shared folder once.
    """
    pin_batches(rows.sparkSession)
    chunks = written(chunked(turns_in_order(rows, conv, turn, role, text, copies), chunk_turns, chunk_bytes), "turn-chunks")
    rules = rows.sparkSession.sparkContext.broadcast(grammar_of(chunks, most_rules))
    whole = solved_whole(chunks.where("whole"), rules)
    cut = chunks.where("not whole")
    parts = written(folded(cut, rules), "audit-parts")
    made = written(parts_edited(cut, parts), "repaired-parts")
    lines = F.array_join(F.transform("turns_out", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    span = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    names = ["gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
    one = whole.withColumns({"gaps": span, "repaired_sha256": F.sha2(lines.cast("binary"), 256)})
    ended = parts.where("ends").withColumnRenamed("conv", "c")
    hashes = hashed_parts(made)
    several = ended.join(hashes, F.col("c").eqNullSafe(F.col("conv"))).select("conv", *names)
    conversations = one.select("conv", *names).unionByName(several).withColumnRenamed("conv", conv)
    turns = whole.select("conv", "chunk", "turns_out").unionByName(made)
    turns = turns.select(F.col("conv").alias(conv), "chunk", F.posexplode("turns_out").alias("place", "t")).select(conv, "chunk", "place", "t.*")
    return Repaired(conversations, turns)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with known faults: by a checksum of ``conv:turn``, modulo 20, a turn is dropped (0), emptied (1),
    robbed of its ends of sentences (2), repeated (3) or given to the user (4). ``copies`` says how often a row counts.

    Nulls are one space. Dropped rows stay with 0 copies, so that their conversation is not lost.
    """
    known = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known(conv), F.lit(":"), known(turn)).cast("binary")) % 20
    said = known(text)
    return rows.select(
        col(conv).alias(conv),
        col(turn).alias(turn),
        F.when(kind == 4, F.lit("user")).otherwise(known(role)).alias(role),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(said, ".!?", "")).otherwise(said).alias(text),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
