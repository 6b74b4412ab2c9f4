"""Document scores from a subword lattice.

The vocabulary is that of a public subword tokenizer; its pieces and the order
of their scores are taken as they are. Scores that are no probabilities (merge
ranks) start as 1 / rank and are re-estimated on the training words: the
expected use of each piece over all segmentations of every distinct training
word, times the word's count (one forward-backward pass per round), smoothed.
The probability of a word is the sum over all its segmentations into pieces,
by a forward recursion in log space; a character outside the vocabulary is
spelled by byte pieces. Pieces start words (with a leading mark) or go on inside
them, so a document's marginal probability is the product over its words and
one end symbol: distinct words are scored once, not once per place.

Word counts are summed in the tasks and then by one aggregation. A document
needs the values of its words: those of the ``HEAD`` most frequent words of at
most ``HEAD_WORD`` bytes (so of a fixed number of bytes at most, broadcast) are
looked up where the text is read, the rest are
joined with the whole word table by key, and both are summed per document.
Nothing is left out, and nothing that grows with the corpus is broadcast.

Null text counts as empty: its only token is the end. Repeated rows and ids
keep their rows. A null id is not held out. Without training rows all counts
are zero. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import ship, text_of, written
from facsimile.llm.tokens import BytesTable, array_slices
from facsimile.llm.words import BETWEEN_SPACES, find_words

HEAD, HEAD_WORD = 200_000, 64  # words whose values are broadcast, and their bytes at most
GROUP = 200_000  # lattice nodes handled together
ROUNDS = 1  # re-estimations
SMOOTH = 0.1  # added to the expected use of each piece
MARK = "▁"
LOG10 = math.log(10)


@dataclass
class Vocabulary:
    """Log probabilities (natural) of pieces, bytes and the end symbol."""

    pieces: dict[str, float]
    spelled: list[float]  # by byte
    end: float

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces that can occur in words in lower case, scored 1 / rank."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    usable = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and MARK not in piece[1:] and not any("A" <= c <= "Z" for c in piece):
            usable.append((-model.get_score(i), piece))
    weights = {p: 1.0 / (r + 2) for r, (_, p) in enumerate(sorted(usable))}
    return _normalised(weights, [1e-4] * 256, 1e-2)


def _normalised(pieces: dict[str, float], spelled: list[float], end: float) -> Vocabulary:
    total = math.log(math.fsum(pieces.values()) + math.fsum(spelled) + end)
    return Vocabulary({p: math.log(v) - total for p, v in pieces.items()}, [math.log(v) - total for v in spelled], math.log(end) - total)


class Lattice:
    """All segmentations of many words at once, in log space.

    Words are sorted by falling length and laid out by character place: the
    nodes of place t are those of the words with at least t characters, one run
    of an array, so every step of the recursions adds such runs. Pieces are
    found by walking a trie (one sorted table) from all nodes together.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.names = sorted(vocabulary.pieces)
        self.log = np.array([vocabulary.pieces[n] for n in self.names])
        self.spelled = np.array(vocabulary.spelled)
        self.longest = vocabulary.longest
        nodes, ends = {"": 0}, {}
        keys, children = [], []
        for k, name in enumerate(self.names):
            for i in range(1, len(name) + 1):
                if name[:i] not in nodes:
                    nodes[name[:i]] = len(nodes)
                    keys.append(nodes[name[: i - 1]] << 21 | ord(name[i - 1]))
                    children.append(nodes[name[:i]])
            ends[nodes[name]] = k
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.children = np.array(keys, np.int64)[order], np.array(children, np.int64)[order]
        self.piece = np.full(len(nodes), -1)
        self.piece[list(ends.keys())] = list(ends.values())

    def _child(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        key = nodes << 21 | letters
        k = np.searchsorted(self.keys, key)
        k[k == len(self.keys)] = 0
        return np.where(self.keys[k] == key, self.children[k], -1) if len(self.keys) else np.full(len(key), -1)

    def _fill(self, words: list[str]) -> None:
        """Lay out marked words of falling length and find their edges."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        top = int(sizes[0])
        self.counts = len(words) - np.searchsorted(sizes[::-1], np.arange(top + 2))  # words with at least t characters
        self.base = np.append(0, np.cumsum(self.counts))
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.letters = np.zeros(self.base[-1], np.int64)
        self.letters[self.base[place] + word] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.ends = self.base[sizes] + np.arange(len(words))
        self.places = np.repeat(np.arange(top + 2), self.counts)
        self.words = np.arange(self.base[-1]) - self.base[self.places]
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []  # (nodes, pieces) by length
        self.values: list[np.ndarray] = []
        inside = np.ones(self.base[-1], bool)
        inside[self.ends] = False
        nodes = starts = np.flatnonzero(inside)
        state = np.zeros(len(nodes), np.int64)
        for d in range(1, min(self.longest, top) + 1):
            at = self.places[nodes] + d - 1
            alive = self.words[nodes] < self.counts[at + 1]
            nodes, state, at = nodes[alive], state[alive], at[alive]
            state = self._child(state, self.letters[self.base[at] + self.words[nodes]])
            nodes, state = nodes[state >= 0], state[state >= 0]
            piece = self.piece[state]
            found, piece = nodes[piece >= 0], piece[piece >= 0]
            value = np.full(self.base[-1], -np.inf)
            value[found] = self.log[piece]
            if d == 1:
                self.bare = np.setdiff1d(starts, found, assume_unique=True)  # spelled by bytes
                letters, back = np.unique(self.letters[self.bare], return_inverse=True)
                self.spellings = [list(chr(c).encode()) for c in letters], back
                value[self.bare] = np.array([self.spelled[s].sum() for s in self.spellings[0]])[back] if len(letters) else 0
            self.edges.append((found, piece))
            self.values.append(value)
        if not self.edges:
            self.edges, self.values, self.bare, self.spellings = [], [], starts, ([], starts)
        self.used = [np.bincount(self.places[np.concatenate([e[0], self.bare]) if d == 0 else e[0]], minlength=top + 2) > 0 for d, e in enumerate(self.edges)]

    def _ahead(self) -> np.ndarray:
        out = np.zeros(self.base[-1])
        for t in range(1, len(self.counts) - 1):
            c = self.counts[t]
            ways = [out[(o := self.base[t - d]) : o + c] + self.values[d - 1][o : o + c] for d in range(1, min(t, len(self.values)) + 1) if self.used[d - 1][t - d]]
            out[self.base[t] : self.base[t] + c] = _log_sums(ways)
        return out

    def _back(self) -> np.ndarray:
        out = np.zeros(self.base[-1])
        for t in range(len(self.counts) - 3, -1, -1):
            c = self.counts[t + 1]
            ways = []
            for d in range(1, min(len(self.counts) - 2 - t, len(self.values)) + 1):
                if self.used[d - 1][t]:
                    n = self.counts[t + d]
                    way = np.full(c, -np.inf)
                    way[:n] = self.values[d - 1][self.base[t] : self.base[t] + n] + out[self.base[t + d] : self.base[t + d] + n]
                    ways.append(way)
            out[self.base[t] : self.base[t] + c] = _log_sums(ways)
        return out

    def _groups(self, words: list[str]):
        """(numbers, marked words) of groups of words of falling length, with at most GROUP nodes or one word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(-sizes, kind="stable")
        upto = np.cumsum(sizes[order] + 1)
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GROUP, side="right")))
            yield order[at:to], [MARK + words[i] for i in order[at:to].tolist()]
            at = to

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, summed over all its segmentations."""
        out = np.zeros(len(words))
        for numbers, marked in self._groups(words):
            self._fill(marked)
            out[numbers] = self._ahead()[self.ends]
        return out

    def expected_use(self, words: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected use of each piece and each byte in the words, times the words' weights."""
        pieces, spelled = np.zeros(len(self.names)), np.zeros(256)
        for numbers, marked in self._groups(words):
            self._fill(marked)
            ahead, back = self._ahead(), self._back()
            total, weight = ahead[self.ends], weights[numbers]

            def share(nodes, d):
                w = self.words[nodes]
                return weight[w] * np.exp(ahead[nodes] + self.values[d - 1][nodes] + back[self.base[self.places[nodes] + d] + w] - total[w])

            for d, (nodes, found) in enumerate(self.edges, 1):
                pieces += np.bincount(found, share(nodes, d), len(self.names))
            by_letter = np.bincount(self.spellings[1], share(self.bare, 1), len(self.spellings[0]))
            for letter, x in zip(self.spellings[0], by_letter.tolist()):
                for b in letter:
                    spelled[b] += x
        return pieces, spelled


def _log_sums(ways: list[np.ndarray]) -> np.ndarray:
    if len(ways) == 1:
        return ways[0]
    stacked = np.stack(ways)
    top = stacked.max(axis=0)
    return top + np.log(np.exp(stacked - top).sum(axis=0))


def _texts_and_flags(batch: pa.RecordBatch):
    """(first row, held flags, words) of slices of a batch."""
    held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
    for at, texts in array_slices(batch, "text"):
        yield at, held[at : at + len(texts)], find_words(texts, BETWEEN_SPACES, lower=True)


def _count(batches):
    for batch in batches:
        for _, held, words in _texts_and_flags(batch):
            n = len(words.distinct)
            train = words.codes[~held[words.texts]]
            ends = [int((~held).sum())], [len(held)]  # the end is the empty word, which no word equals
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words.distinct.cast(pa.binary()), pa.array([b""], pa.binary())]), pa.array(np.append(np.bincount(train, minlength=n), ends[0])), pa.array(np.append(np.bincount(words.codes, minlength=n), ends[1]))],
                ["word", "c", "n"],
            )


def _use(lattice: Lattice):
    def run(batches):
        pieces, spelled = np.zeros(len(lattice.names)), np.zeros(256)
        for batch in batches:
            words = batch.column("word").cast(pa.string()).to_pylist()
            for total, more in zip((pieces, spelled), lattice.expected_use(words, batch.column("c").to_numpy().astype(np.float64))):
                total += more
        number = np.flatnonzero(np.concatenate([pieces, spelled]))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.concatenate([pieces, spelled])[number])], ["number", "uses"])

    return run


def _score_words(lattice: Lattice, end: float):
    def run(batches):
        for batch in batches:
            words, c = batch.column("word").cast(pa.string()).to_pylist(), batch.column("c").to_numpy()
            scores = np.where(np.array([not w for w in words], bool), end, lattice.forward(words)) / LOG10
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(np.log10(c + 1)), pa.array((c > 0).astype(np.int64)), pa.array(scores)], ["word", "n", "base", "known", "score"])

    return run


_SUMS = "row bigint, id bigint, held boolean, tokens bigint, word binary, times bigint, base double, known bigint, score double"


def _sum_documents(head):
    def run(batches):
        table, values = head.value
        end = int(table.find(pa.array([b""], pa.binary()))[0])
        for batch in batches:
            rows, ids = batch.column("row").to_numpy(), batch.column("id")
            for at, held, words in _texts_and_flags(batch):
                n, texts = len(held), words.texts
                row = rows[at : at + n]
                place = table.find(words.distinct)[words.codes] if len(words.distinct) else words.codes
                met = place >= 0
                sums = [np.bincount(texts[met], v[place[met]], n) + (v[end] if end >= 0 else 0) for v in values]
                # Words that are not in the table go on as rows, as does the end.
                pairs, times = np.unique(texts[~met] * max(len(words.distinct), 1) + words.codes[~met], return_counts=True)
                doc, code = np.divmod(pairs, max(len(words.distinct), 1))
                rest = words.distinct.take(pa.array(code)).cast(pa.binary())
                if end < 0:
                    doc, times = np.append(doc, np.arange(n)), np.append(times, np.ones(n, np.int64))
                    rest = pa.concat_arrays([rest, pa.array([b""] * n, pa.binary())])
                none = lambda kind: pa.nulls(len(doc), kind)
                # The row's own sums; its key has a space, so it meets no word.
                own = pa.array([b" %d" % r for r in row.tolist()], pa.binary())
                columns = [
                    pa.array(np.append(row[doc], row)), pa.concat_arrays([none(pa.int64()), ids.slice(at, n)]), pa.concat_arrays([none(pa.bool_()), pa.array(held)]),
                    pa.concat_arrays([none(pa.int64()), pa.array(np.diff(words.places) + 1)]), pa.concat_arrays([rest, own]), pa.array(np.append(times, np.ones(n, np.int64))),
                    *[pa.concat_arrays([none(kind), pa.array(v).cast(kind)]) for kind, v in zip((pa.float64(), pa.int64(), pa.float64()), sums)],
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SUMS.split(", ")])

    return run


def fit_vocabulary(words: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Vocabulary:
    """Re-estimate piece probabilities on the word table (word, c)."""
    train = words.filter("c > 0")
    ends = train.filter(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0
    for _ in range(rounds):
        lattice = Lattice(vocabulary)
        found = train.filter(F.length("word") > 0).select("word", "c").mapInArrow(_use(lattice), "number bigint, uses double")
        uses = np.full(len(lattice.names) + 256, SMOOTH)
        for r in found.groupBy("number").agg(F.sum("uses").alias("uses")).collect():  # at most the vocabulary
            uses[r.number] += r.uses
        uses = uses.tolist()
        vocabulary = _normalised(dict(zip(lattice.names, uses)), uses[len(lattice.names) :], ends + SMOOTH)
    return vocabulary


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document.

    Held out are the documents whose crc32 of the id as text is 2 modulo 7;
    counts and piece probabilities come from the others.
    """
    spark = docs.sparkSession
    ship(spark)
    id_ = F.col(f"`{id_col}`").cast("bigint")
    held = F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), id_.alias("id"), held.alias("held"), text_of(text_col).alias("text"))
    counted = rows.select("held", "text").mapInArrow(_count, "word binary, c bigint, n bigint")
    words = written(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    train, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    vocabulary = fit_vocabulary(words, read_vocabulary(model or default_model()), rounds)
    values = written(words.mapInArrow(_score_words(Lattice(vocabulary), vocabulary.end), "word binary, n bigint, base double, known bigint, score double"), "word-scores")
    top = values.filter(F.octet_length("word") <= HEAD_WORD).orderBy(F.desc("n"), "word").limit(HEAD).toArrow().combine_chunks()
    table = BytesTable(top.column("word").combine_chunks() if top.num_rows else pa.array([], pa.binary()))
    head = spark.sparkContext.broadcast((table, [top.column(c).to_numpy() for c in ("base", "known", "score")]))
    parts = rows.mapInArrow(_sum_documents(head), _SUMS)
    v = {c: F.coalesce(F.col(f"p.{c}"), F.col("p.times") * F.col(f"v.{c}")).alias(c) for c in ("base", "known", "score")}
    met = parts.alias("p").join(values.alias("v"), F.col("p.word") == F.col("v.word"), "left").select("p.row", "p.id", "p.held", "p.tokens", *v.values())
    sums = met.groupBy("row").agg(F.max("id").alias("id"), F.max("held").alias("held_out"), F.max("tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in v])
    return sums.select(
        "id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(train).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(train + distinct + 1)).alias("base_score"), "score",
    )
