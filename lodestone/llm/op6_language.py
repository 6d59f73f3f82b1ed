"""Language ID with a linear-chain conditional random field.

Every word gets a distribution over languages by forward-backward, from hashed features of the word (affixes, character
n-grams, membership in the lexicon of the training sample) and learned transitions between neighbours, so texts that switch
languages are labelled word by word. A document's language is the one with the greatest share of its words.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import held_out, table

UNKNOWN = "und"
#: The classifier is fitted on at most so many distinct texts of each language, drawn by hash, of a longer one on a run of so many
#: bytes at most, and on RUNS runs of TRAIN_WORDS words of each language.
TEXTS, TEXT_BYTES, RUNS = 400, 20_000, 1600
#: Hashed features; words of a training sequence; gradient steps.
FEATURES, TRAIN_WORDS, STEPS = 1 << 16, 32, 40
#: The most languages of a model.
LANGUAGES = 1000
#: Characters of a word; longer ones are pieces that are words of the same sequence.
PIECE = 40
#: Words whose scores a worker keeps, and words whose features are told at once.
KEPT, TOGETHER = 1 << 18, 1 << 14


def features(word: str, lexicon: frozenset, size: int = FEATURES) -> list[int]:
    """Numbers of the features of a lower-cased word: affixes of 1 to 4, n-grams of 2 and 3 characters, the word if known."""
    w = f"<{word}>"
    found = [f"p{w[:n]}" for n in (2, 3, 4)] + [f"s{w[-n:]}" for n in (2, 3, 4, 5)]
    found += [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]
    if word in lexicon:
        found.append(f"l{word}")
    return [zlib.crc32(f.encode("utf8", "surrogatepass")) % size for f in found]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32's steps by byte, and which code points are letters."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return step, np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features_of(words: list[str], lexicon: frozenset, size: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of many words, one after the other, where each word's begin, and whether it has a letter. A run of characters has
    the CRC of the one that is a character shorter, carried on."""
    crc, alpha = _tables()
    text = "".join(f"<{w}>" for w in words)
    data, points = np.frombuffer(text.encode("utf8", "surrogatepass"), np.uint8), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.r_[np.flatnonzero(data & 0xC0 != 0x80), len(data)]
    width = np.diff(edge)
    wide = width.max(initial=1) > 1
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(n) - n

    def on(state: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The states of CRC-32 after one more character each."""
        out = crc[(state ^ data[edge[at]]) & 255] ^ (state >> 8)
        k, more = 1, np.flatnonzero(width[at] > 1) if wide else ()
        while len(more):
            out[more] = crc[(out[more] ^ data[edge[at[more]] + k]) & 255] ^ (out[more] >> 8)
            k += 1
            more = more[width[at[more]] > k]
        return out

    begin = lambda mark, rows: np.full(rows, zlib.crc32(mark) ^ 0xFFFFFFFF, np.uint32)
    known = np.fromiter((w in lexicon for w in words), bool, len(words))
    count = 7 + 2 * n - 3 + known
    starts = np.cumsum(count) - count
    out = np.empty(count.sum(), np.uint32)
    state = on(begin(b"p", len(n)), first)
    for i in (1, 2, 3):
        longer = np.flatnonzero(n > i)
        state[longer] = on(state[longer], first[longer] + i)
        out[starts + i - 1] = state
    for i in (2, 3, 4, 5):
        state, taken = begin(b"s", len(n)), np.minimum(n, i)
        for j in range(i):
            some = np.flatnonzero(taken > j)
            state[some] = on(state[some], (first + n - taken + j)[some])
        out[starts + i + 1] = state
    place, start = np.arange(len(points)) - np.repeat(first, n), np.repeat(starts + 7, n)
    two = np.flatnonzero(place < np.repeat(n - 1, n))
    state = on(on(begin(b"", len(two)), two), two + 1)
    out[start[two] + place[two]] = state
    more = place[two] < np.repeat(n - 2, n)[two]
    three = two[more]
    out[(start + np.repeat(n - 1, n))[three] + place[three]] = on(state[more], three + 2)
    out ^= np.uint32(0xFFFFFFFF)
    named = np.flatnonzero(known)
    out[(starts + count - 1)[named]] = [zlib.crc32(f"l{words[i]}".encode("utf8", "surrogatepass")) for i in named.tolist()]
    return (out % np.uint32(size)).astype(np.int64), starts, np.logical_or.reduceat(alpha[points], first)


def words_of(text: str) -> list[str]:
    """The lower-cased words; one of more than PIECE characters, as text without blanks has, in pieces of that size."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """scores: (sequences, words, labels). Posteriors of the labels, zero beyond a length, and summed posteriors of
    neighbours' labels (labels, labels)."""
    b, t, n = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(step)
    live = np.arange(t)[None, :] < lengths[:, None]
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    x = emit[:, 0] * np.exp(start)
    alpha[:, 0] = x / x.sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = (alpha[:, i - 1] @ move) * emit[:, i]
        alpha[:, i] = x / x.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        x = (emit[:, i + 1] * beta[:, i + 1]) @ move.T
        beta[:, i] = np.where(live[:, i + 1, None], x / x.sum(axis=1, keepdims=True), 1.0)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    pairs = np.zeros((n, n))
    for i in range(1, t):
        right = emit[:, i] * beta[:, i]
        z = ((alpha[:, i - 1] @ move) * right).sum(axis=1)
        w = np.where(live[:, i], 1.0 / np.maximum(z, 1e-300), 0.0)
        pairs += (alpha[:, i - 1] * w[:, None]).T @ right * move
    return post * live[:, :, None], pairs


def training_sequences(texts: list[tuple[str, str]], labels: list[str], seed: int = 1) -> list[tuple[list[str], list[int]]]:
    """Sequences of words with their labels: half of one language, half switched between languages after 3 to 12 words."""
    rng = random.Random(seed)
    runs: dict[int, list[list[str]]] = {i: [] for i in range(len(labels))}
    for text, lang in texts:
        words = words_of(text)
        runs[labels.index(lang)] += [words[i : i + TRAIN_WORDS] for i in range(0, len(words), TRAIN_WORDS)]
    out = []
    for i, mine in runs.items():
        rng.shuffle(mine)
        runs[i] = mine = mine[:RUNS]
        out += [(r, [i] * len(r)) for r in mine]
    usable = [i for i, r in runs.items() if r]
    for _ in range(len(out) if len(usable) > 1 else 0):
        words, tags = [], []
        while len(words) < TRAIN_WORDS:
            i = rng.choice(usable)
            run = rng.choice(runs[i])
            n = rng.randint(3, 12)
            at = rng.randrange(max(1, len(run) - n + 1))
            words += run[at : at + n]
            tags += [i] * len(run[at : at + n])
        out.append((words[:TRAIN_WORDS], tags[:TRAIN_WORDS]))
    return [(w, t) for w, t in out if w]


def fit(texts: list[tuple[str, str]], steps: int = STEPS, size: int = FEATURES) -> dict:
    """The model of (text, language) rows: labels, lexicon, weights (features, labels), start and transition scores."""
    labels = sorted({lang for _, lang in texts})
    if not labels:
        return {"labels": [], "lexicon": frozenset(), "weights": np.zeros((size, 0), np.float32), "start": np.zeros(0), "step": np.zeros((0, 0))}
    sequences = training_sequences(texts, labels)
    counts = Counter(w for words, _ in sequences for w in words)
    lexicon = frozenset(w for w, n in counts.items() if n >= 5)
    number = {w: i for i, w in enumerate(counts)}
    of_word = [features(w, lexicon, size) for w in number]
    lens = np.array([len(f) for f in of_word])
    feats, owner = np.concatenate([np.array(f) for f in of_word]), np.repeat(np.arange(len(lens)), lens)
    n, t, k = len(sequences), max(len(w) for w, _ in sequences), len(labels)
    ids, gold, lengths = np.zeros((n, t), np.int64), np.zeros((n, t), np.int64), np.array([len(w) for w, _ in sequences])
    for i, (words, tags) in enumerate(sequences):
        ids[i, : len(words)] = [number[w] for w in words]
        gold[i, : len(words)] = tags
    live = np.arange(t)[None, :] < lengths[:, None]
    true = np.eye(k)[gold] * live[:, :, None]
    true_pairs = np.einsum("bik,bil->kl", true[:, :-1], true[:, 1:])
    weights, start, step = np.zeros((size, k)), np.zeros(k), np.zeros((k, k))
    seen = [np.full_like(x, 1e-8) for x in (weights, start, step)]
    total = live.sum()
    for _ in range(steps):
        scores = np.stack([np.bincount(owner, weights[feats, j], len(lens)) for j in range(k)], axis=1)
        post, pairs = forward_backward(scores[ids], lengths, start, step)
        off = (true - post).reshape(-1, k)
        of_words = np.stack([np.bincount(ids.ravel(), off[:, j], len(lens)) for j in range(k)], axis=1)
        grads = (
            np.stack([np.bincount(feats, of_words[owner, j], size) for j in range(k)], axis=1) / total - 1e-6 * weights,
            (true[:, 0] - post[:, 0]).sum(axis=0) / total,
            (true_pairs - pairs) / total - 1e-6 * step,
        )
        for x, g, s in zip((weights, start, step), grads, seen):
            s += g * g
            x += 0.3 * g / np.sqrt(s)
    return {"labels": labels, "lexicon": lexicon, "weights": weights.astype(np.float32), "start": start, "step": step}


class Labeller:
    """A model with the factors exp(score) of the words it has met lately, by label, the greatest 1."""

    def __init__(self, model: dict):
        self.model, self.k = model, len(model["labels"])
        self._clear()

    def _clear(self):
        self.number, self.n = {}, 0
        self.emit, self.letters = np.ones((1024, self.k)), np.zeros(1024, bool)

    def ids(self, words: list[str]) -> np.ndarray:
        fresh, weights = list(set(words).difference(self.number)), self.model["weights"]
        while self.n + len(fresh) > len(self.emit):
            self.emit, self.letters = np.concatenate([self.emit, np.ones_like(self.emit)]), np.concatenate([self.letters, np.zeros_like(self.letters)])
        for at in range(0, len(fresh), TOGETHER):
            some = fresh[at : at + TOGETHER]
            found, starts, letters = features_of(some, self.model["lexicon"], len(weights))
            score = np.add.reduceat(weights[found], starts, axis=0).astype(np.float64)
            own = slice(self.n, self.n + len(some))
            self.letters[own] = letters
            self.emit[own] = np.where(letters[:, None], np.exp(score - score.max(axis=1, keepdims=True)), 1.0)
            self.number.update(zip(some, range(self.n, self.n + len(some))))
            self.n += len(some)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, posteriors of the labels of every word in turn, whether it has a letter)."""
        if self.n > KEPT:
            self._clear()
        words = [words_of(t) for t in texts]
        flat, count = self.ids([w for x in words for w in x]), np.array([len(x) for x in words], np.int64)
        return count, posteriors(self.emit[flat], count, np.exp(self.model["start"]), np.exp(self.model["step"])), self.letters[flat]

    def documents(self, texts: list[str]) -> np.ndarray:
        """For each text the summed posteriors of its words with a letter, (texts, labels)."""
        out = np.zeros((len(texts), self.k))
        if self.k:
            count, post, letters = self.words(texts)
            np.add.at(out, np.repeat(np.arange(len(texts)), count)[letters], post[letters])
        return out


def posteriors(emit: np.ndarray, count: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Forward-backward over whole sequences. emit: (words, labels), sequence after sequence, `count` words each.

    All sequences take each step together, the longest first, so that those that still go on are the first ones.
    """
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    if not len(order):
        return np.zeros_like(emit)
    length, first = count[order], (np.cumsum(count) - count)[order]
    # live[i]: how many sequences have a word i; at[i]: where these words' rows begin in the order of steps.
    live = len(order) - np.searchsorted(length[::-1], np.arange(length[0]), "right")
    at = np.r_[0, np.cumsum(live)]
    place = np.concatenate([first[:n] + i for i, n in enumerate(live.tolist())])
    x = emit[place]
    alpha = np.empty_like(x)
    now = x[: at[1]] * start
    alpha[: at[1]] = now = now / now.sum(axis=1, keepdims=True)
    bounds = at.tolist()
    for i in range(1, len(live)):
        lo, hi = bounds[i], bounds[i + 1]
        now = (now[: hi - lo] @ move) * x[lo:hi]
        now /= now.sum(axis=1, keepdims=True)
        alpha[lo:hi] = now
    beta, back = np.ones((live[-1], emit.shape[1])), move.T
    for i in range(len(live) - 2, -1, -1):
        lo, hi, end = bounds[i], bounds[i + 1], bounds[i + 2]
        ahead = (x[hi:end] * beta) @ back
        ahead /= ahead.sum(axis=1, keepdims=True)
        beta = np.ones((hi - lo, emit.shape[1]))
        beta[: end - hi] = ahead
        alpha[lo:hi] *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    out = np.empty_like(emit)
    out[place] = alpha
    return out


def runs_of(words: list[str], post: np.ndarray, labels: list[str]) -> list[dict]:
    """Runs of words with the same likeliest label: start and end (exclusive) in words, and the language."""
    best = post.argmax(axis=1)
    edge = np.r_[0, np.flatnonzero(best[1:] != best[:-1]) + 1, len(best)].tolist() if len(best) else []
    return [{"start": i, "end": j, "lang": labels[best[i]]} for i, j in zip(edge, edge[1:])]


_labeller: dict = {}


def _predict(shared, batches):
    model = shared.value
    if _labeller.get("of") is not model:
        _labeller["of"], _labeller["own"] = model, Labeller(model)
    own, labels = _labeller["own"], model["labels"]
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        langs, scores, i = [], [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < 2_000_000):
                size += len(texts[j])
                j += 1
            for row in own.documents(texts[i:j]):
                total = row.sum()
                best = int(row.argmax()) if len(row) and total > 0 else -1
                langs.append(labels[best] if best >= 0 else UNKNOWN)
                scores.append(min(1.0, float(row[best] / total)) if best >= 0 else 0.0)
            i = j
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])


def training_sample(docs: DataFrame, text_col: str, lang_col: str, texts: int = TEXTS, text_bytes: int = TEXT_BYTES) -> list[tuple[str, str]]:
    """At most `texts` distinct texts of each language, those with the least hashes, a run of words drawn by hash of those over
    `text_bytes`; bounded by languages x texts x bytes."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # A character has four bytes at most; words that the run's ends cut are left out.
    even, chars = F.regexp_replace("text", r"\s+", " "), max(1, text_bytes // 4)
    run = F.substring(even, F.pmod("h", F.greatest(F.length(even) - chars, F.lit(0)) + 1).cast("int") + 1, F.lit(chars))
    run = F.regexp_replace(F.regexp_replace(run, r"^\S{1,40}\s", ""), r"\s\S{1,40}$", "")
    # One number for each language, as the model has. Before anything is shuffled, hashes are cut so that about twice the
    # texts asked for remain, for any number of documents.
    counts = rows.select("lang", "h").distinct().groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"a model has at most {LANGUAGES} languages")
    share = {r["lang"]: min(1.0, 2.0 * texts / r["count"]) for r in counts}
    if not share:
        return []
    limit = F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 30)))))
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < limit[F.col("lang")]).dropDuplicates(["lang", "h"])
    ranked = drawn.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(F.col("nth") <= texts)
    text = F.when(F.octet_length("text") <= text_bytes, F.col("text")).otherwise(run)
    return sorted((r.text, r.lang) for r in ranked.select(text.alias("text"), "lang").collect())


def identify_languages(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS) -> DataFrame:
    """One row per row of docs: the id, lang_pred and score (the share of the language among the words, 0 to 1).

    train: a column of docs, true for the rows to learn from; a null or false one, a null language or a null text teaches
    nothing. A null text, one without a letter, or any text where nothing was learned, is `und` with score 0. Only the text
    enters a prediction. Null ids and repeated rows stay. Other columns aren't read. An empty table gives no rows. Texts of any
    length are labelled whole, as one sequence. label_words() gives the words' labels.
    """
    model = fit(training_sample(docs.where(train), text_col, lang_col, texts))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(partial(_predict, shared), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def label_words(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS) -> DataFrame:
    """One row per row of docs: the id and runs, the stretches of words of one language in the order of the text (start, end
    exclusive, lang). Words as words_of() gives them; learned from as in identify_languages(). No words, or nothing learned, is
    an empty array."""
    model = fit(training_sample(docs.where(train), text_col, lang_col, texts))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batches):
        own = Labeller(shared.value)
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                found.append(runs_of(words_of(t or ""), own.words([t or ""])[1], own.model["labels"]) if own.k else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["id", "runs"])

    out = rows.mapInArrow(label, f"id {rows.schema['id'].dataType.simpleString()}, runs array<struct<start:int,end:int,lang:string>>")
    return out.withColumnRenamed("id", id_col)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 4)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs, ~out).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language": op6_language}
ORACLES: dict[str, str] = {}
