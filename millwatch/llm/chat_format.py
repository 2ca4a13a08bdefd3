"""Chat formatting: a hidden Markov model recovers the roles of transcript lines before turns are rendered."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millwatch.llm.common import stage

ROLES = ("system", "user", "assistant")
#: A state is a role and whether the line opens its turn.
STATES = [(role, opens) for role in ROLES for opens in (True, False)]
#: Lines of a transcript that are searched as one piece; pieces are joined by their best scores.
PIECE = 512

# Words that transcripts mark speakers with.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "you", "question", "q", "customer", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model", "gpt"),
}
ROLE_OF = {word: role for role, words in MARKERS.items() for word in words}
#: A speaker's name, perhaps in brackets, stars or behind a hash or bar, then a colon or closing bracket.
MARKER = re.compile(r"^\s*(?:[#>*\[<(|_-]+\s*)*([A-Za-z]{1,12})\s*(?:\d+\s*)?(?:[|*_]*\s*[:\]>)][\]>)|*_:]*)\s*")
STYLES = ("{0}: {1}", "**{0}:** {1}", "[{0}] {1}", "### {0}:\n{1}", "<{0}> {1}", "{0}> {1}")
#: Speaker names that a style uses for system, user and assistant.
NAMES = (("System", "User", "Assistant"), ("Instructions", "Human", "AI"), ("Context", "Q", "A"), ("SYSTEM", "USER", "BOT"))
SYMBOLS = 4 * 2 * 2 * 3
START = len(STATES)


def marker_of(line: str) -> tuple[str | None, int]:
    """The role a line's marker names, if it has one, and the length of the marker."""
    found = MARKER.match(line)
    role = ROLE_OF.get(found[1].lower()) if found else None
    return (role, found.end()) if role else (None, 0)


def symbol(line: str, after_blank: bool) -> int:
    """A line's features as one symbol: marker, question, place after a blank line, and length."""
    role, end = marker_of(line)
    body = line[end:].strip()
    mark = 0 if role is None else 1 + ROLES.index(role)
    size = 0 if not body else 1 if len(body) < 60 else 2
    return ((mark * 2 + body.endswith("?")) * 2 + after_blank) * 3 + size


def _symbols(lines: list[str], before: str | None) -> np.ndarray:
    previous = [before, *lines[:-1]]
    return np.array([symbol(x, p is not None and not p.strip()) for x, p in zip(lines, previous)], np.int64)


def written(conversations: DataFrame) -> DataFrame:
    """``(conv_id, piece, place, role, opens, line)``: conversations as transcript lines, their roles kept beside them.

    The style and speaker names follow from the hash of conv_id. A line that would read as a marker of its own is escaped by a
    backslash, which rendering takes away again.
    """
    key = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES) * len(NAMES)))
    turns = conversations.where(F.col("conv_id").isNotNull() & F.col("role").isin(*ROLES)).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), key.alias("style"))
    lines = turns.mapInArrow(_written, "conv_id long, turn long, role string, digest long, again long, opens boolean, number int, line string")
    # Two-level numbering: lines of earlier turns, summed per block of turns, then within the block.
    at = ("turn", "role", "digest", "again", "number")
    block = F.floor(F.coalesce("turn", F.lit(-1)) / 64)
    counted = lines.groupBy("conv_id", block.alias("block")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("conv_id", "block").orderBy(*(F.col(c).asc_nulls_first() for c in at))
    placed = lines.withColumn("block", block).withColumn("row", F.row_number().over(order))
    placed = placed.join(counted, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b")))
    place = F.col("base") + F.col("row") - 1
    return placed.select("conv_id", F.floor(place / PIECE).alias("piece"), place.alias("place"), "role", "opens", "line")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    from xxhash import xxh64_intdigest

    again = TaskContext.get().partitionId() << 40  # keeps the lines of equal rows apart
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for row in batch.to_pylist():
            style, names = STYLES[row["style"] % len(STYLES)], NAMES[row["style"] // len(STYLES)]
            body = [("\\" + x if x.startswith("\\") or marker_of(x)[0] else x) for x in row["text"].split("\n")]
            name = names[ROLES.index(row["role"])]
            lines = style.format(name, "\0").replace("\0", "\n".join(body)).split("\n")
            digest, again = xxh64_intdigest(row["text"]) >> 1, again + 1
            for number, line in enumerate(lines):
                for column, value in zip(out, (row["conv_id"], row["turn"], row["role"], digest, again, number == 0, number, line)):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string())
        names_ = ["conv_id", "turn", "role", "digest", "again", "opens", "number", "line"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names_)


class RoleModel:
    """Log-probabilities of a hidden Markov model over line states, from counts."""

    def __init__(self, moves: np.ndarray, shows: np.ndarray):
        self.start = np.log(moves[START] + 0.5) - np.log((moves[START] + 0.5).sum())
        self.moves = np.log(moves[:START] + 0.5) - np.log((moves[:START] + 0.5).sum(axis=1, keepdims=True))
        self.shows = np.log(shows + 0.1) - np.log((shows + 0.1).sum(axis=1, keepdims=True))
        # By definition, a role changes only where a turn opens, and a marker opens a turn of its role.
        for k, (role, opens) in enumerate(STATES):
            if not opens:
                self.start[k] = -1e4
                for j, (before, _) in enumerate(STATES):
                    if before != role:
                        self.moves[j, k] = -1e4
        for k, (role, opens) in enumerate(STATES):
            for s in range(SYMBOLS):
                mark = s // 12
                if mark and (not opens or ROLES[mark - 1] != role):
                    self.shows[k, s] = -1e4

    def step_scores(self, symbols: np.ndarray) -> np.ndarray:
        """Best score of a piece from each state before it to each state of its last line."""
        best = np.full((len(STATES), len(STATES)), -np.inf)
        np.fill_diagonal(best, 0.0)
        for s in symbols:
            best = (best[:, :, None] + self.moves[None]).max(axis=1) + self.shows[:, s]
        return best

    def first_scores(self, symbols: np.ndarray) -> np.ndarray:
        """Best score of a transcript's first piece to each state of its last line."""
        best = self.start + self.shows[:, symbols[0]]
        for s in symbols[1:]:
            best = (best[:, None] + self.moves).max(axis=0) + self.shows[:, s]
        return best

    def path(self, symbols: np.ndarray, entry: int | None, end: int | None) -> list[int]:
        """Viterbi states of a piece, given the state before it (None: a transcript's start) and its last state (None: any)."""
        first = self.start if entry is None else self.moves[entry]
        score, back = first + self.shows[:, symbols[0]], []
        for s in symbols[1:]:
            joined = score[:, None] + self.moves
            back.append(joined.argmax(axis=0))
            score = joined.max(axis=0) + self.shows[:, s]
        state = int(score.argmax()) if end is None else end
        states = [state]
        for step in reversed(back):
            state = int(step[state])
            states.append(state)
        return states[::-1]


def learn_roles(lines: DataFrame) -> RoleModel:
    """Counts of moves and symbols over all labelled ``lines``; tables of fixed size reach the driver."""
    ordered = _pieces(lines, "role", "opens")
    counts = ordered.mapInArrow(_counted, "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    moves, shows = np.zeros((len(STATES) + 1, len(STATES))), np.zeros((len(STATES), SYMBOLS))
    for r in counts:
        (moves if r["kind"] == 0 else shows)[r["a"], r["b"]] = r["n"]
    return RoleModel(moves, shows)


def _pieces(lines: DataFrame, *more: str) -> DataFrame:
    """One row per piece of a transcript with its lines in order and the line before it; bounded by ``PIECE``."""
    row = F.sort_array(F.collect_list(F.struct("place", "line", *more))).alias("rows")
    pieces = lines.groupBy("conv_id", "piece").agg(row)
    ends = lines.where(F.pmod("place", F.lit(PIECE)) == PIECE - 1)
    ends = ends.select("conv_id", (F.col("piece") + 1).alias("piece"), *(F.col(c).alias(f"before_{c}") for c in ("line", *more)))
    return pieces.join(ends, ["conv_id", "piece"], "left")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    moves, shows = np.zeros((len(STATES) + 1, len(STATES)), np.int64), np.zeros((len(STATES), SYMBOLS), np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            states = [STATES.index((x["role"], x["opens"])) for x in row["rows"]]
            before = START if row["before_role"] is None else STATES.index((row["before_role"], row["before_opens"]))
            np.add.at(moves, ([before, *states[:-1]], states), 1)
            np.add.at(shows, (states, _symbols([x["line"] for x in row["rows"]], row["before_line"])), 1)
    rows = [(k, int(a), int(b), int(t[a, b])) for k, t in enumerate((moves, shows)) for a, b in zip(*np.nonzero(t))]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(4)], ["kind", "a", "b", "n"])


def _scored(model: RoleModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for rows, before in zip(batch.column("rows").to_pylist(), batch.column("before_line").to_pylist()):
                symbols = _symbols([x["line"] for x in rows], before)
                table = model.step_scores(symbols) if before is not None else model.first_scores(symbols)
                scores.append(table.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), pa.array(scores, pa.binary())], ["conv_id", "piece", "scores"])

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best path over whole pieces: the state before and the last state of each."""
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            tables = [np.frombuffer(x["scores"]) for x in row["tables"]]
            score, back = tables[0], []
            for t in tables[1:]:
                joined = score[:, None] + t.reshape(len(STATES), -1)
                back.append(joined.argmax(axis=0))
                score = joined.max(axis=0)
            states = [int(score.argmax())]
            for step in reversed(back):
                states.append(int(step[states[-1]]))
            states.reverse()
            out += [(row["conv_id"], x["piece"], s, b) for x, s, b in zip(row["tables"], states, [None, *states[:-1]])]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(4)], ["conv_id", "piece", "end", "entry"])


def _recovered(model: RoleModel):
    """The lines of each piece with role, whether they open a turn, and their text without marker and escape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row in batch.to_pylist():
                lines = [x["line"] for x in row["rows"]]
                path = model.path(_symbols(lines, row["before_line"]), row["entry"], row["end"])
                before = None if row["entry"] is None else STATES[row["entry"]][0]
                for x, state in zip(row["rows"], path):
                    role, opens = STATES[state]
                    body = x["line"][marker_of(x["line"])[1] :] if opens else x["line"]
                    body = body[1:] if body.startswith("\\") else body
                    for column, value in zip(out, (row["conv_id"], row["piece"], x["place"], role, opens or role != before, body)):
                        column.append(value)
                    before = role
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["conv_id", "piece", "place", "role", "opens", "line"])

    return run


def transcript_lines(transcripts: DataFrame) -> DataFrame:
    """``(conv_id, piece, place, line)`` of ``transcripts(conv_id, text)``; a null text has no lines."""
    lines = transcripts.where("conv_id is not null").select("conv_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.select("conv_id", F.floor(F.col("place") / PIECE).alias("piece"), F.col("place").cast("long").alias("place"), "line")


def rendered(role: Column, text: Column) -> Column:
    """The canonical form of a turn."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>"))


def parse_transcripts(lines: DataFrame, model: RoleModel) -> DataFrame:
    """``(conv_id, turn, role, text, rendered)``: the turns of transcripts given as ``lines(conv_id, piece, place, line)``.

    A hidden Markov model over line states (role, opens a turn or goes on) reads each line's speaker marker, question mark,
    blank line before and length. Its Viterbi path is that of the whole transcript: pieces of 512 lines are scored from every
    state to every state, the best states at their borders follow from those tables, and each piece is then traced
    back between its borders, so a transcript of any length is many tasks. A turn starts where the path opens one or changes
    role; its text is its lines without marker, trimmed at both ends.

    Lines without any marker keep the role of the path. A turn that is only a marker has an empty text. Transcripts
    without lines give no turns, rows with a null conv_id take no part, repeated conv_ids are one transcript. An empty table
    gives an empty result. Other columns are ignored.
    """
    pieces = stage(_pieces(lines.select("conv_id", "piece", "place", "line")), "transcript-pieces")
    scores = pieces.mapInArrow(_scored(model), "conv_id long, piece long, scores binary")
    tables = scores.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "scores"))).alias("tables"))
    ends = tables.mapInArrow(_ends, "conv_id long, piece long, end int, entry int")
    known = pieces.join(ends, ["conv_id", "piece"])
    done = stage(known.mapInArrow(_recovered(model), "conv_id long, piece long, place long, role string, opens boolean, line string"), "transcript-roles")
    opened = F.sum(F.col("opens").cast("long"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = done.groupBy("conv_id", "piece").agg(opened.alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = base.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), "base")
    inside = Window.partitionBy("conv_id", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = done.withColumn("inside", opened.over(inside)).join(base, (F.col("conv_id") == F.col("c")) & (F.col("piece") == F.col("p")))
    numbered = numbered.withColumn("turn", F.col("base") + F.col("inside") - 1)
    rows = F.sort_array(F.collect_list(F.struct("place", "line")))
    turns = numbered.groupBy("conv_id", "turn").agg(F.first("role").alias("role"), rows.alias("rows"))
    text = F.btrim(F.concat_ws("\n", F.col("rows.line")), F.lit(" \t\r\n"))
    turns = turns.select("conv_id", "turn", "role", text.alias("text"))
    return turns.withColumn("rendered", rendered(F.col("role"), F.col("text")))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Conversations written as transcripts of many styles, and parsed again: the columns of ``parse_transcripts``.

    The model's counts come from all transcript lines and their known roles. Turns with a null or unknown role or a null conv_id take
    no part; a null text is an empty one; a null turn comes first; rows that repeat a turn follow each other in order of role
    and text hash.
    """
    lines = stage(written(conversations), "transcript-lines")
    return parse_transcripts(lines, learn_roles(lines))
