"""Language-model scores from a subword lattice.

A text is its words and one end; a word is a core between ASCII punctuation, which has a distribution of its own.
The lattice of a core has every way to cut it into pieces of an existing vocabulary, of any length, and all single
bytes. The pieces' prior probabilities come from the vocabulary's own scores: of a unigram file the scores are log
probabilities; of a BPE file they are merge ranks, which Zipf's law turns into probabilities. Forms that differ in the
case of A-Z alone are one piece and share their sum. Weights are adapted to the training documents as a Dirichlet
interpolation, (expected uses + ``PRIOR`` x prior) / (all uses + ``PRIOR``), with expected uses over all distinct
training cores by forward and backward sums. A core seen in training is one more edge of its own lattice: its count
less the absolute discount n1 / (n1 + 2 n2), and the mass so freed goes to the cuts. The forward recursion in log space
gives a core's marginal probability over all of that. A document draws its own distribution of cores, and one of
punctuations, from a Dirichlet of weight ``OWN`` around these, which is marginal too: a core that occurs m times among
n counts gamma(OWN p + m) / gamma(OWN p), and all n together gamma(OWN) / gamma(OWN + n). All of it is normalised: the
probabilities of all texts sum to at most one.

Counts are of all training documents and gathered by word; no other column of the documents is read. At scoring, the
``FREQUENT`` words and punctuations most used in any document are broadcast; all others meet their weights in a shuffle,
none of them in more than a ``FREQUENT``-th of the uses. Nothing that grows with the corpus is broadcast.

Defined results: a null text has the end alone; rows that agree in id and text get equal results, one row each;
without training texts every token is unknown and weights are the prior's; an empty table gives none; very long texts are
taken whole, a slice of tokens at a time.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, fresh_path

#: Parts (words and punctuations) that are broadcast, the most used: at about 200 bytes each, 20 MB.
FREQUENT = 100_000
#: Expected uses that the vocabulary's own scores count for, and of these the part of the ends of words.
PRIOR, PRIOR_END = 2_000.0, 0.25
#: Zipf-Mandelbrot's shift, for vocabularies whose scores are ranks.
ZIPF = 2.7
ROUNDS = 2
#: Weight of the corpus against the words that a document has had so far: as so many of its words.
OWN = 1000.0
_FLUSH = 400_000
#: Tokens, and distinct words, that numpy works on at a time.
_SLICE, _WORDS_AT_ONCE = 200_000, 65_536
#: The end of a text as a token: no word holds a space. Keys with a space and more are of punctuation.
END = b" "
#: The key of no punctuation at all.
PLAIN = b" \0"
_PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z alone, ASCII white space alone


def split_word(word: bytes) -> tuple[bytes, bytes]:
    """The core, and the key of the punctuation around it."""
    core = word.strip(_PUNCTUATION)
    if len(core) == len(word):
        return core, PLAIN
    at = len(word) - len(word.lstrip(_PUNCTUATION))
    return core, b" " + word[:at] + b"\0" + (word[at + len(core) :] if core else b"")


# -- pieces ------------------------------------------------------------------


_MIX = np.uint64(0x100000001B3)


class Pieces:
    """An existing vocabulary as sorted keys by length, with log weights; the last weight is the end of a word.

    ``pieces``: their probabilities by name, or names alone for even ones. Keys are the bytes themselves up to eight, and
    64-bit hashes beyond.
    """

    def __init__(self, pieces: dict[bytes, float] | list[bytes], weights: np.ndarray | None = None):
        self.pieces = sorted(set(pieces) | {bytes([b]) for b in range(256)}, key=lambda p: (len(p), p))
        if weights is None and isinstance(pieces, dict):
            least = min(pieces.values(), default=1.0)
            prior = np.array([pieces.get(p, least) for p in self.pieces])
            self.weights = np.log(np.append(prior / prior.sum() * (1 - PRIOR_END), PRIOR_END))
        else:
            self.weights = np.full(len(self.pieces) + 1, -math.log(len(self.pieces) + 1)) if weights is None else weights
        self.keys, self.first, self.order = {}, {}, {}
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces):
            by_size.setdefault(len(p), []).append(i)
        for n, mine in by_size.items():
            letters = np.frombuffer(b"".join([self.pieces[i] for i in mine]), np.uint8).reshape(len(mine), n).astype(np.uint64)
            key = np.zeros(len(mine), np.uint64)
            for k in range(n):
                key = (key << np.uint64(8)) | letters[:, k] if n <= 8 else (key ^ letters[:, k]) * _MIX
            self.order[n] = np.argsort(key)
            self.keys[n], self.first[n] = key[self.order[n]], mine[0]

    def edges(self, letters: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, piece numbers, whether there is one) of the pieces from each place of equally long words."""
        out = []
        key = mixed = np.zeros(letters.shape, np.uint64)
        for n in range(1, min(max(self.keys), letters.shape[1]) + 1):
            ends = letters[:, n - 1 :]
            if n <= 8:
                key = (key[:, : ends.shape[1]] << np.uint64(8)) | ends
            mixed = (mixed[:, : ends.shape[1]] ^ ends) * _MIX
            known = self.keys.get(n)
            if known is not None:
                mine = key if n <= 8 else mixed
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                has = known[at] == mine
                if has.any():
                    out.append((n, self.order[n][at] + self.first[n], has))
        return out

    def forward(self, letters: np.ndarray, edges: list) -> np.ndarray:
        """Log sum over all cuts of the first j letters, for each j."""
        total = np.full((letters.shape[0], letters.shape[1] + 1), -np.inf)
        total[:, 0] = 0.0
        for j in range(1, letters.shape[1] + 1):
            into = [np.where(has[:, j - n], total[:, j - n] + self.weights[piece[:, j - n]], -np.inf) for n, piece, has in edges if n <= j]
            total[:, j] = np.logaddexp.reduce(into, axis=0)
        return total

    def expected(self, letters: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words, each counted ``times``."""
        edges = self.edges(letters)
        ahead = self.forward(letters, edges)
        size = letters.shape[1]
        back = np.full_like(ahead, -np.inf)
        back[:, size] = 0.0
        counts = np.zeros(len(self.weights))
        for i in range(size - 1, -1, -1):
            onward = []
            for n, piece, has in edges:
                if i + n <= size:
                    w = np.where(has[:, i], self.weights[piece[:, i]] + back[:, i + n], -np.inf)
                    onward.append(w)
                    use = np.exp(ahead[:, i] + w - ahead[:, size]) * times
                    counts += np.bincount(piece[:, i], use, len(counts))
            back[:, i] = np.logaddexp.reduce(onward, axis=0)
        counts[-1] += times.sum()
        return counts

    def log_words(self, words: list[bytes], weights: list[np.ndarray]) -> np.ndarray:
        """Log probability of each word over all its cuts, under each of ``weights``."""
        out = np.empty((len(words), len(weights)))
        for rows, letters in _by_size(words):
            edges = self.edges(letters)
            for k, self.weights in enumerate(weights):
                out[rows, k] = self.forward(letters, edges)[:, -1] + self.weights[-1]
        return out


def _by_size(words: list[bytes], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and letters of words of one size, at most ``most`` letters at a time (or one word)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        step = max(1, most // max(size, 1))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), size).astype(np.uint64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``_WORDS_AT_ONCE`` rows or a little more: words of one size are then enough for each step of numpy."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _WORDS_AT_ONCE:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def sentencepiece_vocabulary(path: str) -> dict[bytes, float]:
    """Pieces of an existing SentencePiece file and their probabilities by its own scores, A-Z in lower case and without
    its word mark. Scores that are whole numbers are ranks, as BPE files have them; others are log probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scored = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ranks = all(score == int(score) for _, score in scored)
    pieces: dict[bytes, float] = {}
    for piece, score in scored:
        raw = piece.replace("▁", "").encode().lower()
        if raw and len(raw.split()) == 1:
            pieces[raw] = pieces.get(raw, 0.0) + (1 / (ZIPF - score) if ranks else math.exp(score))
    return pieces


# -- counts ------------------------------------------------------------------


def _counted():
    """Rows (word, n as a token, m as a core or punctuation, uses in any text) of training texts; words of other texts come
    with zeros for n and m, to get weights too."""

    def flush(trained: Counter, others: Counter) -> pa.RecordBatch:
        words, n, m, uses = [], [], [], []
        for counts, learn in ((trained, 1), (others, 0)):
            parts: dict[bytes, int] = {}
            plain, get = 0, parts.get
            for w, c in counts.items():
                core = w.strip(_PUNCTUATION)
                if w == END:
                    parts[w] = c
                elif core and len(core) == len(w):
                    parts[w] = get(w, 0) + c
                    plain += c
                else:
                    for part in split_word(w):
                        parts[part] = get(part, 0) + c
            if plain:
                parts[PLAIN] = get(PLAIN, 0) + plain
            rest = [w for w in parts if w not in counts]
            tokens = np.array([*counts.values(), *([0] * len(rest))], np.int64)
            held = np.array([*[get(w, 0) for w in counts], *map(get, rest)], np.int64)
            words += [*counts, *rest]
            n.append(tokens * learn)
            m.append(held * learn)
            uses.append(np.maximum(tokens, held))
            counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *[pa.array(np.concatenate(c)) for c in (n, m, uses)]], ["word", "n", "m", "uses"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, others = Counter(), Counter()
        for batch in batches:
            for text, learn in zip(batch.column(0), batch.column(1).to_pylist()):
                mine = trained if learn else others
                mine.update(words_of(text.as_py()))
                mine[END] += 1
                if len(trained) + len(others) > _FLUSH:
                    yield flush(trained, others)
        yield flush(trained, others)

    return run


def _is_core() -> Column:
    """Cores and the end; not the keys of punctuation."""
    return (F.col("word") == F.lit(bytearray(END))) | (F.substring("word", 1, 1) != F.lit(bytearray(END)))


class Discounted:
    """Counts less a discount: the log of what is left of each, and of the mass for what was never seen."""

    def __init__(self, total: float, distinct: float, once: float, twice: float):
        self.total, self.distinct = total, distinct
        self.discount = min(0.95, max(0.05, once / max(once + 2 * twice, 1)))
        self.new = math.log(self.discount * distinct / total) if total else 0.0

    def log(self, counts: np.ndarray, unseen: np.ndarray) -> np.ndarray:
        """``unseen``: log probability of each among all that can be."""
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(counts - self.discount, 0) / max(self.total, 1)), self.new + unseen)


#: Terms of the rising factorial that are taken one by one; Stirling's series, good to 1e-10 from there on, has the rest.
_FIRST = 6


def _stirling(x, log):
    """log gamma of x but for a constant."""
    return (x - 0.5) * log(x) - x + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def rising(m: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """log10 of a (a + 1) ... (a + m - 1) for a = OWN p, from log10 p."""
    a = OWN * np.power(10.0, log_p)
    out = np.where(m > 0, math.log10(OWN) + log_p, 0.0)
    for k in range(1, _FIRST):
        out += np.where(m > k, np.log10(a + k), 0.0)
    rest = _stirling(np.maximum(m, _FIRST) + a, np.log) - _stirling(_FIRST + a, np.log)
    return out + np.where(m > _FIRST, rest / math.log(10), 0.0)


def _rising_column(m: Column, log_p: Column) -> Column:
    a = F.lit(OWN) * F.pow(F.lit(10.0), log_p)
    out = F.when(m > 0, F.lit(math.log10(OWN)) + log_p).otherwise(0.0)
    for k in range(1, _FIRST):
        out += F.when(m > k, F.log10(a + k)).otherwise(0.0)
    return out + F.when(m > _FIRST, (_stirling(m + a, F.log) - _stirling(a + _FIRST, F.log)) / math.log(10)).otherwise(0.0)


class Weights:
    """From counts and lattice sums to log10 probabilities of tokens, cores and punctuations. One small row of totals."""

    def __init__(self, word_counts: DataFrame):
        core = _is_core()
        t, c = F.col("t"), F.col("c")
        asked = [F.sum("t"), F.count_if(t > 0)]
        for kind in (core, ~core):
            asked += [F.sum(F.when(kind, c)), F.count_if(kind & (c > 0)), F.count_if(kind & (c == 1)), F.count_if(kind & (c == 2))]
        row = [float(x or 0) for x in word_counts.agg(*asked).first()]
        self.tokens, self.distinct = row[:2]
        self.cores, self.shapes = Discounted(*row[2:6]), Discounted(*row[6:10])

    def log10(self, words: list[bytes], counts: np.ndarray, lattice: Pieces) -> np.ndarray:
        kind = np.array([2 if w == END else 1 if w[:1] == END else 0 for w in words], np.int64)
        out = np.zeros(len(words))
        cores = np.flatnonzero(kind == 0)
        v = max(self.cores.distinct, 1)
        # the end has no cuts: its share of the discounted mass is that of one core of the distinct ones
        out[cores] = lattice.log_words([words[i] for i in cores], [lattice.weights])[:, 0] + math.log(v / (v + 1))
        out[kind == 2] = -math.log(v + 1)
        spelled = np.flatnonzero(kind == 1)
        out[spelled] = -math.log(257) * np.array([len(words[i]) for i in spelled])
        mine = kind != 1
        out[mine] = self.cores.log(counts[mine], out[mine])
        out[~mine] = self.shapes.log(counts[~mine], out[~mine])
        return out / math.log(10)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))


def train_pieces(word_counts: DataFrame, vocabulary: dict[bytes, float] | list[bytes], rounds: int = ROUNDS) -> np.ndarray:
    """Piece weights from the vocabulary's own and from expected uses in its distinct cores, each once: what new words are like."""
    prior = np.exp(Pieces(vocabulary).weights)
    weights = np.log(prior)
    words = word_counts.where((F.col("c") > 0) & (F.substring("word", 1, 1) != F.lit(bytearray(END))) & (F.length("word") > 0)).select("word")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            mine = Pieces(vocabulary)
            mine.weights = weights
            counts = np.zeros(len(weights))
            for batch in _gathered(batches):
                for _, letters in _by_size(batch.column(0).to_pylist()):
                    counts += mine.expected(letters, np.ones(len(letters)))
            piece = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(counts[piece])], ["piece", "n"])

        # at most as many rows as the vocabulary has pieces
        found = words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        counts = PRIOR * prior
        np.add.at(counts, found.column("piece").to_numpy(), found.column("n").to_numpy())
        weights = np.log(counts / counts.sum())
    return weights


# -- scores ------------------------------------------------------------------


def _weigh(weights: Weights, vocabulary: dict[bytes, float] | list[bytes], piece_weights: np.ndarray):
    """From (word, t, c) to (word, known, base, log)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Pieces(vocabulary)
        for batch in _gathered(batches):
            words = batch.column(0).to_pylist()
            tokens, counts = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
            lattice.weights = piece_weights
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens > 0), pa.array(weights.base(tokens)), pa.array(weights.log10(words, counts, lattice))], ["word", "known", "base", "log"])

    return run


class _Numbers(dict):
    """Numbers of the words and punctuations met so far; of each its place among the frequent ones (or -1), and the numbers
    of its core and of its punctuation (-1 for the end), found once a word."""

    def __init__(self, number: dict[bytes, int]):
        super().__init__()
        self.number = number
        self.words: list[bytes] = []
        self.place, self.core, self.shape = array("q"), array("q"), array("q")

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.words)
        self.words.append(word)
        self.place.append(self.number.get(word, -1))
        self.core.append(at)
        self.shape.append(-1)
        if word[:1] != END:
            core, shape = split_word(word)
            self.shape[at] = self[shape]
            if core != word:
                self.core[at] = self[core]
        return at


def _split_frequent(frequent: dict):
    """From (id, hash, text): sums over frequent parts on one row of the text's own, and its other parts with counts.

    ``n`` counts a word as a token, ``m`` as a core or punctuation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(frequent["words"])}
        known, base, log = frequent["known"], frequent["base"], frequent["log"]
        met = _Numbers(number)

        def rows(part: pa.RecordBatch, sizes: list[int], ids: list[int]) -> pa.RecordBatch:
            docs, span = len(sizes), len(met.words)
            place, core, shape = np.array(met.place), np.array(met.core), np.array(met.shape)
            key, c = np.unique(np.repeat(np.arange(docs), sizes) * span + np.array(ids, np.int64), return_counts=True)
            doc, word = key // span, key % span
            around = shape[word] >= 0
            part_key, of_part = np.unique(np.concatenate([doc * span + core[word], (doc * span + shape[word])[around]]), return_inverse=True)
            part_c = np.bincount(of_part, np.concatenate([c, c[around]])).astype(np.int64)
            often, part_often = place[word], place[part_key % span]
            a, b = often >= 0, part_often >= 0
            sums = [np.bincount(doc[a], c[a] * x[often[a]], docs) for x in (known, base)]
            sums.append(np.bincount(part_key[b] // span, rising(part_c[b], log[part_often[b]]), docs))

            rare = np.union1d(key[~a], part_key[~b])
            n, m = np.zeros((2, docs + len(rare)), np.int64)
            n[docs + np.searchsorted(rare, key[~a])] = c[~a]
            m[docs + np.searchsorted(rare, part_key[~b])] = part_c[~b]
            # a text's own row has no word: it finds no weights, and spreads by the text's hash
            hashes = part.column(1).to_numpy(zero_copy_only=False)
            names = [END + hashes[i].tobytes() + b"%d" % i for i in range(docs)]
            names += map(met.words.__getitem__, (rare % span).tolist())
            take = pa.array(np.concatenate([np.arange(docs), rare // span]))
            size = np.concatenate([np.array(sizes, np.int64), np.zeros(len(rare), np.int64)])
            offsets = np.minimum(np.arange(docs + len(rare) + 1), docs).astype(np.int32) * 3
            absent = np.arange(len(offsets)) >= docs
            absent[-1] = False
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=absent), pa.array(np.stack(sums, 1).reshape(-1)))
            return pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(names, pa.binary()), pa.array(n), pa.array(m), pa.array(size), lists], ["id", "text_hash", "word", "n", "m", "size", "sums"])

        for batch in batches:
            sizes, ids, first = [], [], 0
            for i, text in enumerate(batch.column(2)):
                words = words_of(text.as_py())
                words.append(END)
                sizes.append(len(words))
                ids.extend(map(met.__getitem__, words))
                if len(ids) > _SLICE or i + 1 == batch.num_rows:
                    yield rows(batch.slice(first, len(sizes)), sizes, ids)
                    sizes, ids, first = [], [], i + 1
                    if len(met) > _FLUSH:
                        met = _Numbers(number)

    return run


def score_documents(docs: DataFrame, train: Column, vocabulary: dict[bytes, float] | list[bytes], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row. ``train``: which rows are learned from."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    counted = docs.select(text.alias("text"), F.coalesce(train, F.lit(False)).alias("learn")).mapInArrow(_counted(), "word binary, n long, m long, uses long")
    path = fresh_path(spark, "word-counts")
    counted.groupBy("word").agg(F.sum("n").alias("t"), F.sum("m").alias("c"), F.sum("uses").alias("uses")).write.parquet(path)
    word_counts = spark.read.parquet(path)
    weights = Weights(word_counts)
    piece_weights = train_pieces(word_counts, vocabulary)

    schema = "word binary, known boolean, base double, log double"
    weigh = _weigh(weights, vocabulary, piece_weights)
    top = word_counts.orderBy(F.desc("uses"), "word").limit(FREQUENT).select("word", "t", "c")
    common = top.mapInArrow(weigh, schema).toArrow()
    frequent = {
        "words": common.column("word").to_pylist(),
        "known": common.column("known").to_numpy().astype(float),
        "base": common.column("base").to_numpy(),
        "log": common.column("log").to_numpy(),
    }
    held = spark.sparkContext.broadcast(frequent)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _split_frequent(held.value)(batches)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = rows.mapInArrow(split, "id long, text_hash long, word binary, n long, m long, size long, sums array<double>")
    met = rows.join(word_counts.select("word", "t", "c").mapInArrow(weigh, schema), "word", "left")
    zero = F.lit(0.0)
    known = F.coalesce(F.col("sums")[0], F.when(F.col("known"), F.col("n")).otherwise(0).cast("double"))
    base = F.coalesce(F.col("sums")[1], F.col("n") * F.col("base"), zero)
    log = F.coalesce(F.col("sums")[2], _rising_column(F.col("m"), F.col("log")), zero)
    copies = F.count_if(F.col("sums").isNotNull())
    out = met.groupBy("id", "text_hash").agg(copies.alias("copies"), F.sum("size").alias("size"), F.sum(known).alias("known"), F.sum(base).alias("base"), F.sum(log).alias("log"))
    per = lambda c: F.col(c) / F.col("copies")
    # the cores with the end, then the punctuations of all words
    whole = _rising_column(per("size"), F.lit(0.0)) + _rising_column(per("size") - 1, F.lit(0.0))
    out = out.select("id", per("size").alias("size"), per("known").alias("known"), per("base").alias("base"), (per("log") - whole).alias("score"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_"))
    return out.select(F.col("id").alias("doc_id"), F.round("size").cast("long").alias("n_tokens"), F.round("known").cast("long").alias("n_known"), F.lit(int(weights.tokens)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def learned_from(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 7, is not 2."""
    return crc_remainder(F.col(id_col), 7) != 2
