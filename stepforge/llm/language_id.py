"""Language identification with a bidirectional gated recurrent network over bytes.

Texts are cut into windows of ``WINDOW`` bytes that all step through the network together; each
direction starts a window with an empty state, every position gets a distribution over the
learned languages from both directions, and a document's probabilities are the means over its
positions. Training is backpropagation through time in numpy with Adam, on excerpts of a bounded
sample: about ``PER_LANGUAGE`` documents of each language, those with the smallest hash of their
text among documents with a language, so neither doc_id nor source plays a part in a prediction.
Where asked, noise made of the same excerpts (their bytes in random order, or random bytes) is learned
as one more label, ``und``; ``keep_known`` drops texts whose mean probability of noise exceeds a limit,
which ``noise_limit`` reads off labelled documents that the network has not seen.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text
where no document teaches a language; a lang that is itself ``und`` teaches nothing; a null doc_id counts as the empty text in the fold; rows are
kept one for one; equal texts get equal values; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 128
HIDDEN = 8
PER_LANGUAGE = 250
EXCERPT = 256
EPOCHS = 8
#: Bytes that step through the network together: their states stay within a core's cache.
STEP_BYTES = 1 << 19
UND = "und"


def fold(id_col: str, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % parts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Parameters of both directions: input tables (3H, 257), recurrent weights (3H, H); output (L, 2H) and (L, 1)."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.out, self.bias]


def new_network(languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    return Network(
        languages, [draw(3 * hidden, 257) for _ in range(2)], [draw(3 * hidden, hidden) for _ in range(2)], draw(len(languages), 2 * hidden),
        np.zeros((len(languages), 1), np.float32)
    )


def _forward(table: np.ndarray, u: np.ndarray, x: np.ndarray, live: np.ndarray, order: range, keep: list | None = None) -> np.ndarray:
    """States (T, H, B) of one direction over bytes x (T, B); ``live``: which positions are text."""
    h_size, (steps, b) = u.shape[1], x.shape
    states = np.empty((steps, h_size, b), np.float32)
    h = np.zeros((h_size, b), np.float32)
    full = live.all(axis=1)
    for t in order:
        gate = np.take(table, x[t], axis=1)
        carried = u @ h
        zr = _sigmoid(gate[: 2 * h_size] + carried[: 2 * h_size])
        z, r = zr[:h_size], zr[h_size:]
        n = carried[2 * h_size :] * r
        n += gate[2 * h_size :]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((t, h, z, r, n, carried[2 * h_size :]))
        new = h - n
        new *= z
        new += n
        if not full[t]:
            new *= live[t]
        h = states[t] = new
    return states


def _softmax(a: np.ndarray, axis: int) -> np.ndarray:
    a = np.exp(a - a.max(axis=axis, keepdims=True))
    return a / a.sum(axis=axis, keepdims=True)


def _backward(table: np.ndarray, u: np.ndarray, x: np.ndarray, live: np.ndarray, keep: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a direction's table and recurrent weights, through time."""
    h_size = u.shape[1]
    d_u = np.zeros_like(u)
    d_h = np.zeros_like(d_states[0])
    d_in = np.empty((len(x), 3 * h_size, x.shape[1]), np.float32)
    for t, h, z, r, n, carried_n in reversed(keep):
        d = (d_h + d_states[t]) * live[t]
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * carried_n * r * (1 - r)
        d_in[t] = np.concatenate([d_z, d_r, d_n])
        back = np.concatenate([d_z, d_r, d_n * r])
        d_u += back @ h.T
        d_h = d * z + u.T @ back
    d_table = np.zeros((257, 3 * h_size), np.float32)
    np.add.at(d_table, x.ravel(), d_in.transpose(0, 2, 1).reshape(-1, 3 * h_size))
    return d_table.T, d_u


def gradients(net: Network, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the live positions of windows x (T, B) labelled y (B), and its gradients."""
    keeps: list[list] = [[], []]
    orders = (range(len(x)), range(len(x) - 1, -1, -1))
    states = np.concatenate([_forward(net.tables[i], net.recurrent[i], x, live, orders[i], keeps[i]) for i in range(2)], axis=1)
    p = _softmax(net.out @ states + net.bias, 1)
    picked = np.take_along_axis(p, y[None, None, :].repeat(len(x), 0), 1)[:, 0]
    count = max(1, live.sum())
    loss = -(np.log(np.maximum(picked, 1e-20)) * live).sum() / count
    d = p.copy()
    np.put_along_axis(d, y[None, None, :].repeat(len(x), 0), picked[:, None] - 1, 1)
    d *= (live / count)[:, None, :]
    d_out, d_bias = np.einsum("tlb,thb->lh", d, states), d.sum(axis=(0, 2))[:, None]
    d_states = net.out.T @ d
    h = net.recurrent[0].shape[1]
    sides = [_backward(net.tables[i], net.recurrent[i], x, live, keeps[i], d_states[:, i * h : i * h + h]) for i in range(2)]
    return float(loss), [sides[0][0], sides[1][0], sides[0][1], sides[1][1], d_out, d_bias]


def windows(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x (T, B), live (T, B), text of each window): every byte of every text is in exactly one window."""
    lengths = np.diff(offsets)
    many = -(-lengths // size)
    owner = np.repeat(np.arange(len(many)), many)
    first = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * size
    at = first + np.arange(size)[:, None]
    live = at < offsets[owner + 1]
    x = np.where(live, raw[np.minimum(at, max(0, len(raw) - 1))] if len(raw) else 0, 256).astype(np.int32)
    return x, live.astype(np.float32), owner


def fit(texts: list[bytes], labels: list[str], window: int = WINDOW, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 1) -> Network | None:
    """Train on excerpts; None where there are none."""
    languages = sorted(set(labels))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if not len(raw):
        return None
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, live, owner = windows(raw, offsets, window)
    y = np.array([languages.index(s) for s in labels])[owner]
    net, rng = new_network(languages, hidden, seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        for pick in np.array_split(rng.permutation(len(owner)), max(1, len(owner) // batch)):
            step += 1
            _, grads = gradients(net, x[:, pick], live[:, pick], y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, (m, v) in zip(net.parameters(), grads, moments):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (now * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def label(net: Network, raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each text: sums over positions of the probabilities (N, L), and of each position's own label (N, L)."""
    n, count = len(offsets) - 1, len(net.languages)
    pooled, votes = np.zeros((n, count)), np.zeros((n, count))
    x, live, owner = windows(raw, offsets, window)
    if not len(owner):
        return pooled, votes
    ahead = _forward(net.tables[0], net.recurrent[0], x, live, range(len(x)))
    back = _forward(net.tables[1], net.recurrent[1], x, live, range(len(x) - 1, -1, -1))
    h = net.recurrent[0].shape[1]
    mass, own = np.zeros((count, len(owner)), np.float32), np.zeros((count, len(owner)), np.float32)
    for t in range(len(x)):
        a = net.out[:, :h] @ ahead[t]
        a += net.out[:, h:] @ back[t]
        a += net.bias
        top = a.max(axis=0)
        own += (a == top) * live[t]
        a -= top
        np.exp(a, out=a)
        a *= live[t] / a.sum(axis=0)
        mass += a
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    pooled[owner[starts]] = np.add.reduceat(mass.astype(np.float64), starts, axis=1).T
    votes[owner[starts]] = np.add.reduceat(own.astype(np.float64), starts, axis=1).T
    return pooled, votes


def noise(texts: list[bytes], many: int, seed: int = 1) -> list[bytes]:
    """``many`` strings as long as texts drawn at random: by turns their bytes in random order, and random bytes."""
    rng, out = np.random.default_rng(seed), []
    for i in range(many if texts else 0):
        raw = np.frombuffer(texts[int(rng.integers(len(texts)))], np.uint8)
        some = rng.permutation(raw) if i % 2 else rng.integers(33, 256, len(raw)).astype(np.uint8)
        out.append(some.tobytes())
    return out


def _beginnings(texts: list[bytes], labels: list[str], seed: int = 2) -> tuple[list[bytes], list[str]]:
    """A few bytes from the beginning of every text, with its label: short texts are to be told from noise too."""
    cut = np.random.default_rng(seed).integers(3, 48, len(texts))
    return [t[:n] for t, n in zip(texts, cut.tolist())], labels


def hash_limit(n: int, wanted: int) -> int:
    """Of ``n`` hashes of 63 bits about one and a half times the wanted lie below it: enough for a count that is a few per cent wrong."""
    return min(2**63 - 1, 2**63 * 3 * wanted // (2 * max(1, n)))


def smallest(rows, wanted: int) -> list[tuple]:
    """Of rows (language, hash, text) the ``wanted`` with the smallest hash of each language, in order."""
    out: dict[str, list[tuple]] = {}
    for r in sorted(rows):
        if len(own := out.setdefault(r[0], [])) < wanted:
            own.append(r)
    return [r for own in out.values() for r in own]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, excerpt: int = EXCERPT, with_noise: bool = False, **options) -> Network | None:
    """A network fitted on ``per_language`` excerpts of each language of ``docs``, those of the smallest hashes; a language with fewer texts gives all.

    About one and a half times as many reach the driver, whatever the number of texts, and one count a language.

    ``with_noise``: and on as many strings of noise as one language gives excerpts, labelled ``und``.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.col(lang_col) != UND) & F.rlike(F.col(text_col), F.lit(r"\p{L}")))
    h = F.xxhash64(F.lit(7), F.col(text_col))
    # copies share a hash and are drawn together, so the limit goes by texts; one row a language
    counts = known.groupBy(F.col(lang_col).alias("l")).agg(F.approx_count_distinct(h, 0.02).alias("n")).collect()
    if not counts:
        return None
    limit = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], hash_limit(r["n"], per_language))])
    begin = F.pmod(F.shiftright(h, 20), F.greatest(F.length(text_col) - excerpt + 1, F.lit(1))) + 1
    drawn = known.select(F.col(lang_col).alias("l"), F.shiftrightunsigned(h, 1).alias("h"), F.substring(F.col(text_col), begin.cast("int"), F.lit(excerpt)).alias("t"))
    drawn = drawn.where(F.col("h") < F.try_element_at(limit, F.col("l")))  # before any shuffle
    rows = smallest(((r["l"], r["h"], r["t"]) for r in drawn.distinct().collect()), per_language)
    texts, labels = [t.encode() for _, _, t in rows], [lang for lang, _, _ in rows]
    if with_noise and texts:
        unlike = noise(texts, len(texts) // len(set(labels)))
        texts, labels = texts + unlike, labels + [UND] * len(unlike)
        begun = _beginnings(texts, labels)
        texts, labels = texts + begun[0], labels + begun[1]
    return fit(texts, labels, **options)


def _predictions(net: Network | None, column: pa.Array, letters: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, share of positions labelled so, bytes, mean probability of noise) of each text of a batch."""
    offsets, data = C.text_buffers(column)
    n = len(offsets) - 1
    names, score, share, size, unlike = np.full(n, UND, object), np.zeros(n), np.zeros(n), np.diff(offsets), np.zeros(n)
    spoken = [i for i, name in enumerate(net.languages) if name != UND] if net is not None else []
    at = 0
    while net is not None and at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1)
        if to == at + 1:  # a text longer than a chunk is labelled in pieces of whole windows
            pooled = votes = np.zeros((1, len(net.languages)))
            for a in range(int(offsets[at]), int(offsets[to]), STEP_BYTES):
                part = data[a : min(a + STEP_BYTES, offsets[to])]
                p, v = label(net, part, np.array([0, len(part)]), window)
                pooled, votes = pooled + p, votes + v
        else:
            pooled, votes = label(net, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], window)
        best = np.array(spoken)[np.round(pooled[:, spoken], 3).argmax(axis=1)]
        rows, length = np.arange(to - at), np.maximum(size[at:to], 1)
        ok = letters[at:to]
        names[at:to][ok] = np.array(net.languages, object)[best[ok]]
        score[at:to][ok] = np.clip(np.round(pooled[rows, best] / length, 4), 0, 1)[ok]
        share[at:to][ok] = np.round(votes[rows, best] / length, 4)[ok]
        if UND in net.languages:
            unlike[at:to][ok] = np.clip(np.round(pooled[:, net.languages.index(UND)] / length, 4), 0, 1)[ok]
        at = to
    return names, score, share, size, unlike


def _predict(net: Network | None, text_col: str, window: int):
    """Each batch with its letters column replaced by the predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, share, size, unlike = _predictions(net, batch.column(text_col), batch.column("__letters").to_numpy(zero_copy_only=False), window)
            kept = [c for c in batch.schema.names if c != "__letters"]
            yield pa.record_batch(
                [*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(score), pa.array(share), pa.array(size), pa.array(unlike)],
                [*kept, "__lang", "__score", "__share", "__bytes", "__noise"]
            )

    return run


def _labelled(rows: DataFrame, text_col: str, net: Network | None, window: int) -> DataFrame:
    """``rows`` with __lang, __score, __share, __bytes and __noise; one pass, no shuffle."""
    letters = F.coalesce(F.rlike(F.col(text_col), F.lit(r"\p{L}")), F.lit(False))
    given = rows.select("*", letters.alias("__letters"))
    shape = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "__lang string, __score double, __share double, __bytes long, __noise double"])
    return given.mapInArrow(_predict(net, text_col, window), shape)


def noise_limit(docs: DataFrame, net: Network | None, text_col: str = "text", loss: float = 0.001, window: int = WINDOW) -> float:
    """Half way from the mean probability of noise that a share of ``loss`` of these documents exceeds to certainty; 1.0 where there are none."""
    found = _labelled(docs.select(text_col), text_col, net, window).where(F.col("__lang") != UND)
    limit = found.agg(F.percentile_approx("__noise", 1 - loss, 10000)).first()[0]
    return 1.0 if limit is None else (1 + limit) / 2


def keep_known(docs: DataFrame, net: Network | None, text_col: str = "text", lang_col: str = "lang", least: float = 0.0, window: int = WINDOW, most_noise: float = 1.0) -> DataFrame:
    """The rows of ``docs`` whose language is known, with a score of at least ``least`` and noise of at most ``most_noise``; a null language is filled in."""
    found = _labelled(docs, text_col, net, window).where((F.col("__lang") != UND) & (F.col("__score") >= least) & (F.col("__noise") <= most_noise))
    return found.withColumn(lang_col, F.coalesce(F.col(lang_col), F.col("__lang"))).select(*docs.columns)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, held_out, lang_pred, score (mean probability), share (of positions labelled so) and n_bytes of every row."""
    held = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return _labelled(rows, "text", net, window).select(
        "doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__share").alias("share"),
        F.col("__bytes").alias("n_bytes")
    )


def op7_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold("doc_id", 5) == 0
    return identify(docs, train(docs.where(~held)), held_out=held)


QUERIES = {"op7_language_id": op7_language_id}
ORACLE: dict[str, str] = {}
