"""Token counts of whole texts by a finite-state transducer compiled from a sentence-piece BPE vocabulary.

A text's pieces are the only sequence in which every two neighbours are what BPE makes of the two alone, so the last
piece of every prefix follows from the last pieces of a few shorter prefixes: those from where a longer piece could
still begin. These, with the beginnings of pieces that are open there, are a state of a deterministic transducer. Each
transition is annotated with the change of the emitted tokens (negative where pieces grow together). The transducer is
compiled while it runs: a worker keeps the transitions that its texts have used, in one hash table, and starts anew
when they are MOST_TRANSITIONS.

Texts are cut into chunks of about CHUNK characters, before a word's first blank where there is one. All chunks of a
slice advance together, a character a step, and give their state map: from states in which the chunk may begin to the
state at its end and the tokens. A map that begins a word is constant; for another one the state is found by a run
over the characters before it. Maps of a text are composed by a parallel prefix scan; where a chunk is reached in a
state that its map lacks, the maps of the text get the states in which the chunks before them can end, and the scan is repeated: counts
are exact for any text.

Defined results: a null or empty text has no bytes and no tokens; characters outside the vocabulary count their
bytes; special strings in a text are ordinary characters; ill-formed UTF-8 counts as the replacement character; rows
that repeat give repeated rows; an empty table gives an empty result; a very long text is cut into chunks like any other, in
the memory of its task (some 30 bytes a character); kept columns pass through, whatever their names, unless they are the result's own.
Models that are not BPE with byte pieces, a leading blank and unchanged characters are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.llm.common import ready, resident, small_batches

BLANK = "▁"
CHUNK, WARM_UP = 256, 64
SLICE_BYTES = 1 << 20
MOST_TRANSITIONS = 1_500_000
#: Codes of characters outside the vocabulary: one less than their bytes.
OUTSIDE = 4
PROBES = ("", " ", "  a", "a ", "Hello  world", "x\n\ty", "<s>a</s>", "▁aéﬁ　z", "éÅ", "\U0001f600中文\u0000", "aaaa" * 9 + " " * 37 + "==" * 11)


def pieces_of(path: str) -> dict[str, float]:
    """Pieces and scores of a model file; the transducer is compared with the library on a few texts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
    pieces = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not special(i)}
    try:
        told = Transducer(pieces).count(list(PROBES)).tolist()
    except ValueError:
        told = None
    if told != [len(model.encode(x)) for x in PROBES]:
        raise ValueError(f"{path}: not a BPE model with byte pieces, a leading blank and unchanged characters")
    return pieces


class Transducer:
    """States and annotated transitions, compiled as texts need them."""

    def __init__(self, pieces: dict[str, float]):
        self.scores = pieces
        self.whole = {p for p in pieces if len(p) == 1 or self.merged(p) == [p]}
        self.open = {p[:k] for p in self.whole for k in range(1, len(p))}
        if any(BLANK in p.lstrip(BLANK) for p in self.whole):
            raise ValueError("a piece has a blank after another character")
        self.letters = sorted(p for p in self.whole if len(p) == 1)
        code = np.full(0x110000, OUTSIDE - 1, np.uint16)
        code[:0x80], code[0x80:0x800], code[0x800:0x10000] = 0, 1, 2
        for i, x in enumerate(self.letters):
            code[ord(x)] = OUTSIDE + i
        code[0x20] = code[ord(BLANK)]  # blanks are written as that character
        self.code, self.blank = code, int(code[ord(BLANK)])
        self.shift = np.int64(max(1, (OUTSIDE + len(self.letters)).bit_length()))
        self.restart()

    def restart(self) -> None:
        self.pairs: dict[tuple[str, str], bool] = {}
        begin = (("", None, 0),)
        self.states, self.numbers = [begin], {begin: 0}
        self.bits, self.used = 16, 0
        self.table(self.bits)

    def merged(self, text: str) -> list[str]:
        """BPE itself, for strings of two pieces at most: the best pair of neighbours merges, the leftmost of equals."""
        parts = list(text)
        while True:
            found = [(-self.scores[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.scores]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, left: str | None, right: str) -> bool:
        """Whether the pieces stay apart as neighbours; everything may follow a character outside the vocabulary."""
        if left is None:
            return True
        if (left, right) not in self.pairs:
            self.pairs[left, right] = self.merged(left + right) == [left, right]
        return self.pairs[left, right]

    def step(self, state: int, code: int) -> tuple[int, int]:
        """The next state and the tokens it adds. A state lists, from the longest on, each open beginning of a piece
        with the piece before it and the tokens up to there, less those up to here."""
        if code < OUTSIDE:
            return 0, code + 1
        now, x = self.states[state], self.letters[code - OUTSIDE]
        if x == BLANK and (now[-1][1] or "").rstrip(BLANK):
            after, more = ((BLANK, None, -1), ("", BLANK, 0)), 1  # no piece reaches over a word's first blank
        else:
            piece, more = next((y, n + 1) for p, last, n in now if (y := p + x) in self.whole and self.follows(last, y))
            after = (*((p + x, last, n - more) for p, last, n in now if p + x in self.open), ("", piece, 0))
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
        return self.numbers[after], more

    def table(self, bits: int) -> None:
        """An empty hash table of 2**bits places."""
        self.bits = bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.next = np.zeros(1 << bits, np.int32)
        self.more = np.zeros(1 << bits, np.int16)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or an empty place for it."""
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            left = left[(found != keys[left]) & (found >= 0)]
        return at

    def add(self, keys: list[int]) -> None:
        """Compile the transitions of these keys (state and code)."""
        shift, mask = int(self.shift), (1 << int(self.shift)) - 1
        made = [self.step(key >> shift, key & mask) for key in keys]
        self.used += len(keys)
        if 3 * self.used > 1 << self.bits:
            old = np.flatnonzero(self.keys >= 0)
            kept = self.keys[old], self.next[old], self.more[old]
            self.table((3 * self.used).bit_length() + 1)
            self.insert(*kept)
        self.insert(np.array(keys, np.int64), *(np.array(x, np.int64) for x in zip(*made, strict=True)))

    def insert(self, keys: np.ndarray, after: np.ndarray, more: np.ndarray) -> None:
        while len(keys):  # of keys that claim one place, one gets it
            at = self.places(keys)
            self.keys[at] = keys
            mine = self.keys[at] == keys
            self.next[at[mine]], self.more[at[mine]] = after[mine], more[mine]
            keys, after, more = keys[~mine], after[~mine], more[~mine]

    def run(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States at the ends of spans of characters, and the tokens between; all spans advance together."""
        by = np.argsort(-lengths, kind="stable")
        first, size = starts[by], lengths[by]
        state, total = states[by].astype(np.int64), np.zeros(len(by), np.int64)
        longest = int(size.max(initial=0))
        active = np.searchsorted(-size, -np.arange(longest), "left")  # spans of more than t characters
        for t in range(longest):
            k = active[t]
            keys = (state[:k] << self.shift) | codes[first[:k] + t]
            at = self.places(keys)
            missing = self.keys[at] < 0
            if missing.any():
                self.add(np.unique(keys[missing]).tolist())
                at = self.places(keys)
            state[:k] = self.next[at]
            total[:k] += self.more[at]
        end, count = np.empty_like(state), np.empty_like(total)
        end[by], count[by] = state, total
        return end, count

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        if self.used > MOST_TRANSITIONS:
            self.restart()
        out = np.zeros(len(texts), np.int64)
        full = [i for i, x in enumerate(texts) if x]
        if not full:
            return out
        written = "".join(BLANK + texts[i] for i in full)
        codes = self.code[np.frombuffer(written.encode("utf-32-le", "surrogatepass"), "<u4")]
        lengths = np.fromiter((len(texts[i]) + 1 for i in full), np.int64, len(full))
        out[full] = self.composed(codes, lengths)
        return out

    def composed(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        starts, owner, constant = chunks(codes, lengths, self.blank)
        sizes = np.diff(np.append(starts, len(codes)))
        begins = np.zeros(len(starts), np.int64)
        guess = np.flatnonzero(~constant)
        if len(guess):
            text_start = (np.cumsum(lengths) - lengths)[owner[guess]]
            back = np.minimum(WARM_UP, starts[guess] - text_start)
            begins[guess], _ = self.run(codes, starts[guess] - back, back, np.zeros(len(guess), np.int64))
        ends, counts = self.run(codes, starts, sizes, begins)
        maps = StateMaps(constant, begins[:, None], ends[:, None], counts[:, None])
        last = np.append(np.flatnonzero(np.diff(owner)), len(owner) - 1)
        while True:
            scanned = scan(maps, owner)
            open_texts = owner[scanned.ends[:, 0] < 0]
            if not len(open_texts):
                return scanned.counts[last, 0]
            rows, states = maps.lacking(np.isin(owner, open_texts))
            maps = maps.extended(rows, states, *self.run(codes, starts[rows], sizes[rows], states))


def chunks(codes: np.ndarray, lengths: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the chunks of all texts, the text of each, and whether every state may be taken to begin it.

    A cut is moved on to a word's first blank, if one comes before the next cut.
    """
    ends = np.cumsum(lengths)
    number = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), number)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    starts = (ends - lengths)[owner] + place * CHUNK
    words = np.flatnonzero((codes[1:] == blank) & (codes[:-1] != blank)) + 1
    near = np.append(words, len(codes))[np.searchsorted(words, starts)]
    moved = (place > 0) & (near < np.minimum(starts + CHUNK, ends[owner]))
    return np.where(moved, near, starts), owner, moved | (place == 0)


class StateMaps:
    """A row for each chunk: states in which it may begin (all, if constant), then those at its end, and the tokens.

    Absent states are -1, as are ends that are not known.
    """

    def __init__(self, constant: np.ndarray, begins: np.ndarray, ends: np.ndarray, counts: np.ndarray):
        self.constant, self.begins, self.ends, self.counts = constant, begins, ends, counts

    def lacking(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks, and states in which the map of the chunk before ends that their own maps lack."""
        rows = np.flatnonzero(among & ~self.constant)
        row, state = np.repeat(rows, self.ends.shape[1]), self.ends[rows - 1].ravel()
        new = (state >= 0) & ~(self.begins[row] == state[:, None]).any(1)
        found = np.unique(np.column_stack([row[new], state[new]]), axis=0)
        return found[:, 0], found[:, 1]

    def extended(self, rows, begins, ends, counts) -> StateMaps:
        """With more states; rows are in order, and a row may get several."""
        first = np.append(True, rows[1:] != rows[:-1])
        turn = np.arange(len(rows)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        column = (self.begins[rows] >= 0).sum(1) + turn
        more = max(0, int(column.max()) + 1 - self.begins.shape[1])

        def filled(old, values):
            wider = np.pad(old, ((0, 0), (0, more)), constant_values=-1)
            wider[rows, column] = values
            return wider

        return StateMaps(self.constant, filled(self.begins, begins), filled(self.ends, ends), filled(self.counts, counts))

    def after(self, left: StateMaps, mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends and counts of the composition: the left maps (rows `theirs`), then these (rows `mine`)."""
        reached = left.ends[theirs]
        same = (reached[:, :, None] == self.begins[mine][:, None, :]) | self.constant[mine][:, None, None] & (np.arange(self.begins.shape[1]) == 0)
        known, column = same.any(2) & (reached >= 0), same.argmax(2)
        ends = np.take_along_axis(self.ends[mine], column, 1)
        counts = left.counts[theirs] + np.take_along_axis(self.counts[mine], column, 1)
        return np.where(known & (ends >= 0), ends, -1), counts


def scan(maps: StateMaps, owner: np.ndarray) -> StateMaps:
    """The composition of each chunk's map with those of all chunks before it in its text, in log steps."""
    done = StateMaps(maps.constant.copy(), maps.begins.copy(), maps.ends.copy(), maps.counts.copy())
    step, n = 1, len(owner)
    while True:
        mine = np.arange(step, n)
        mine = mine[owner[mine] == owner[mine - step]] if len(mine) else mine
        if not len(mine):
            return done
        ends, counts = done.after(done, mine, mine - step)
        constant, begins = done.constant[mine - step], done.begins[mine - step]
        done.constant[mine], done.begins[mine], done.ends[mine], done.counts[mine] = constant, begins, ends, counts
        step *= 2


def count_batch(batch: pa.RecordBatch, shared):
    """Slices of a batch whose last column is the text, with its bytes and tokens instead."""
    for part in small_batches([batch], SLICE_BYTES):
        machine = resident(shared.value, lambda: Transducer(shared.value))
        raw = part.column(part.num_columns - 1).to_pylist()
        texts = [x.decode("utf-8", "replace") if x else None for x in raw]
        made = [pa.array([len(x or b"") for x in raw], pa.int64()), pa.array(machine.count(texts), pa.int64())]
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], "n_bytes", "n_tokens"])


def count(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_bytes, n_tokens and over_limit (more than `limit` tokens). No shuffle."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(pieces_of(model_path))
    fields = spark.createDataFrame([], "n_bytes long, n_tokens long").schema
    fields = type(fields)(docs.select(*keep).schema.fields + fields.fields)

    def run(batches):
        from attestia.llm import tokencount

        for batch in batches:
            yield from tokencount.count_batch(batch, shared)

    counted = docs.select(*keep, F.col(text).cast("string").cast("binary").alias("_text")).mapInArrow(run, fields)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
