"""Language identification by a convolutional network over bytes.

Every text is read in windows of a fixed number of bytes, all of it.  Filters of several widths slide over the byte
embeddings of a window; their largest responses feed a softmax over the languages.  The windows' log-probabilities,
weighted by their lengths, decide.  The network is trained in numpy on a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.frames import per_batch

WINDOW = 256
UNKNOWN = "und"
ASCII_LETTER = re.compile("[A-Za-z]")
#: Windows scored at once; bounds the memory of a worker.
BATCH = 128


def has_letter(text: str | None) -> bool:
    """True if a character of the text is a letter of any script."""
    return bool(text) and bool(ASCII_LETTER.search(text) or any(map(str.isalpha, text)))


@dataclass
class ByteNet:
    """Embeddings ``emb[256, d]``, filters by width ``[width, d, f]`` with biases, and the output layer."""

    langs: list[str]
    emb: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(langs: list[str], widths=(2, 3, 4), dim: int = 8, count: int = 16, seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        return ByteNet(
            langs,
            rng.normal(0, 0.3, (256, dim)).astype(np.float32),
            {w: rng.normal(0, (w * dim) ** -0.5, (w, dim, count)).astype(np.float32) for w in widths},
            {w: np.zeros(count, np.float32) for w in widths},
            rng.normal(0, 0.1, (count * len(widths), len(langs))).astype(np.float32),
            np.zeros(len(langs), np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.emb, *self.filters.values(), *self.biases.values(), self.out, self.out_bias]

    def step(self, windows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of a batch and its gradients, in the order of ``arrays``."""
        n, dim = len(windows), self.emb.shape[1]
        seen = self.emb[windows]
        pooled, where, spans = [], [], []
        for w, weight in self.filters.items():
            span = np.lib.stride_tricks.sliding_window_view(seen, w, axis=1).transpose(0, 1, 3, 2)
            span = span.reshape(n, WINDOW - w + 1, w * dim)
            response = span @ weight.reshape(w * dim, -1)
            top = response.argmax(axis=1)
            pooled.append(np.take_along_axis(response, top[:, None], axis=1)[:, 0] + self.biases[w])
            where.append(top)
            spans.append(span)
        raw = np.concatenate(pooled, axis=1)
        hidden = np.maximum(raw, 0)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(axis=1, keepdims=True)
        loss = -float(np.log(chance[np.arange(n), target] + 1e-12).mean())
        chance[np.arange(n), target] -= 1
        chance /= n
        back = (chance @ self.out.T) * (raw > 0)
        d_emb, d_filters, d_biases, at = np.zeros_like(self.emb), [], [], 0
        for (w, weight), top, span in zip(self.filters.items(), where, spans):
            count = weight.shape[2]
            part = back[:, at : at + count]
            at += count
            best = np.take_along_axis(span, top[:, :, None], axis=1)  # n, count, w * dim
            d_filters.append(np.einsum("nf,nfk->kf", part, best).reshape(weight.shape))
            d_biases.append(part.sum(axis=0))
            into = part[:, :, None] * weight.reshape(w * dim, count).T[None]
            for j in range(w):
                used = np.take_along_axis(windows, top + j, axis=1)
                np.add.at(d_emb, used.ravel(), into[:, :, j * dim : (j + 1) * dim].reshape(-1, dim))
        return loss, [d_emb, *d_filters, *d_biases, hidden.T @ chance, chance.sum(axis=0)]

    def tables(self) -> list[tuple[int, list[np.ndarray]]]:
        """Per width, what each byte or byte pair adds to the filters' responses."""
        found = []
        for w, weight in self.filters.items():
            single = [self.emb @ weight[j] for j in range(w)]
            single[0] = single[0] + self.biases[w]
            pairs = [(single[j][:, None] + single[j + 1][None, :]).reshape(65536, -1) for j in range(0, w - 1, 2)]
            found.append((w, [np.ascontiguousarray(t) for t in (pairs + single[-1:] if w % 2 else pairs)]))
        return found


def log_chances(net: ByteNet, tables: list, windows: np.ndarray) -> np.ndarray:
    """Log-probabilities of the languages for windows of bytes, by table look-ups instead of products."""
    out = np.empty((len(windows), len(net.langs)))
    for start in range(0, len(windows), BATCH):
        some = windows[start : start + BATCH].astype(np.int32)
        pairs = some[:, :-1] * 256 + some[:, 1:]
        pooled = []
        for w, parts in tables:
            count = WINDOW - w + 1
            response = parts[0].take(pairs[:, :count], axis=0)
            for k, table in enumerate(parts[1:], 1):
                source = some if len(table) == 256 else pairs
                response += table.take(source[:, 2 * k : 2 * k + count], axis=0)
            pooled.append(response.max(axis=1))
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.out + net.out_bias
        top = logits.max(axis=1, keepdims=True)
        out[start : start + BATCH] = logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
    return out


def windows_of(text: str, overlap: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, each repeating the last bytes of the one before, and the bytes new in each."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    step = WINDOW - overlap
    count = max(1, -(-(len(data) - overlap) // step))
    padded = np.zeros(count * step + overlap, np.uint8)
    padded[: len(data)] = data[: len(padded)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]
    fresh = np.full(count, step)
    fresh[-1] = max(1, len(data) - step * (count - 1))
    return windows, fresh


def train(drawn: np.ndarray, langs: list[str], epochs: int = 6, seed: int = 7) -> ByteNet | None:
    """Fit by Adam on windows of known language; None without windows."""
    known = sorted(set(langs))
    if not known:
        return None
    rng = np.random.default_rng(seed)
    target = np.array([known.index(lang) for lang in langs])
    net = ByteNet.fresh(known, seed=seed)
    arrays = net.arrays()
    first, second = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(drawn))
        for start in range(0, len(order), 32):
            pick = order[start : start + 32]
            _, gradients = net.step(drawn[pick], target[pick])
            t += 1
            for a, g, m, v in zip(arrays, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= 0.004 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def held_out(id_column: Column) -> Column:
    """True for rows that no training may see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 400, most: int = 8_000
) -> DataFrame:
    """About ``per_lang`` texts of each language (all, if fewer), none held out, and ``most`` at most.

    Ids are picked before any text is read: languages are counted, then a row stays if a hash of its id is below its
    language's share.  Only the picked ids are broadcast to find their texts.
    """
    usable = docs.where(
        F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_column).isNotNull() & ~held_out(F.col(id_column))
    ).select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = usable.groupBy(F.col("lang").alias("counted")).agg(F.count(F.lit(1)).alias("rows"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    picked = (
        usable.select("id", "lang")
        .join(counts, F.col("lang") == F.col("counted"))
        .where(place * F.col("rows") < per_lang)
        .select(F.col("id").alias("picked"))
        .distinct()
        .orderBy(F.xxhash64("picked"), "picked")
        .limit(most)
    )
    return usable.join(F.broadcast(picked), F.col("id") == F.col("picked")).select("id", "text", "lang")


def training_windows(sample: DataFrame, each: int = 3) -> DataFrame:
    """``(id, k, window, lang)``: up to ``each`` windows from anywhere in each text, drawn by its id.

    Every fifth text is also shown in capitals, so that case alone does not decide.
    """
    fields = [("id", pa.int64()), ("k", pa.int32()), ("window", pa.binary()), ("lang", pa.string())]

    def run(keys: list, texts: list, langs: list) -> list:
        rows = []
        for key, text, lang in zip(keys, texts, langs):
            forms = [text, text.upper()] if key % 5 == 0 else [text]
            for f, form in enumerate(forms):
                some, _ = windows_of(form)
                pick = np.random.default_rng([key % (1 << 32), f]).permutation(len(some))[:each]
                made = [some[j].tobytes() for j in pick]
                rows += [
                    (key, f * each + k, window, lang)
                    for k, window in enumerate(made)
                    if has_letter(window.decode("utf-8", "ignore"))
                ]
        return list(map(list, zip(*rows))) if rows else [[] for _ in fields]

    return sample.select(F.col("id").cast("long"), "text", "lang").mapInArrow(
        per_batch(run, pa.schema(fields), rows=256), "id long, k int, window binary, lang string"
    )


def fit(docs: DataFrame, per_lang: int = 400, max_windows: int = 16_000, **columns: str) -> ByteNet | None:
    """Train on windows of ``training_sample``; at most ``max_windows`` of 256 bytes each reach the driver."""
    windows = training_windows(training_sample(docs, per_lang=per_lang, **columns))
    rows = windows.orderBy(F.xxhash64("id", "k"), "id", "k", "window").limit(max_windows).collect()
    if not rows:
        return None
    drawn = np.frombuffer(b"".join(bytes(r.window) for r in rows), np.uint8).reshape(-1, WINDOW)
    return train(drawn, [r.lang for r in rows])


def predict(
    docs: DataFrame, net: ByteNet | None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(id, lang_pred, score)`` per row from all windows of its text.

    ``und`` with score 0 for null texts and texts without a letter, and everywhere if there was nothing to learn from.
    Repeated rows come out repeatedly; an empty table gives no rows.
    """
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(keys: list, texts: list) -> list:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        tables = _tables(net) if net else None
        chosen = [k for k, t in enumerate(texts) if net and has_letter(t)]
        # windows of many texts are scored together, those of one very long text in several goes
        group, held = [], 0
        for k in [*chosen, None]:
            if k is not None:
                group.append((k, *windows_of(texts[k])))
                held += len(group[-1][1])
            if group and (k is None or held >= 2_048):
                logs = log_chances(net, tables, np.concatenate([windows for _, windows, _ in group]))
                at = 0
                for row, windows, fresh in group:
                    own = logs[at : at + len(windows)]
                    at += len(windows)
                    mean = (own * fresh[:, None]).sum(axis=0) / fresh.sum()
                    chance = np.exp(mean - mean.max())
                    best = int(mean.argmax())
                    langs[row], scores[row] = net.langs[best], float(chance[best] / chance.sum())
                group, held = [], 0
        return [keys, langs, scores]

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(
        per_batch(run, schema, rows=512), "id long, lang_pred string, score double"
    )


_TABLES: dict[bytes, list] = {}


def _tables(net: ByteNet) -> list:
    key = net.out.tobytes()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = net.tables()
    return _TABLES[key]
