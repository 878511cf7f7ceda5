"""Language identification by a byte convolutional network, trained in numpy.

Text bytes (A-Z lower-cased) are cut into windows of ``WINDOW`` bytes that together cover the whole text. A learned byte
embedding, filters of several widths, max pooling over the window and a softmax give each window's probabilities; a
document's are their mean, weighted by the windows' letters. Widths are laid into one matrix, so a batch of windows is one
product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmesh.llm.common import in_blocks

WINDOW = 256
DIM = 8
WIDTHS = (2, 3, 4, 5)
FILTERS = 16
REACH = max(WIDTHS)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_LETTERISH = np.zeros(256, bool)
_LETTERISH[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Windows a product takes at a time.
_BLOCK = 64


@dataclass
class Model:
    """embed (256, DIM), row 0 zero; filters (REACH * DIM, n), zero beyond each width; then a softmax layer."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW + REACH - 1) bytes: each window and what its last filters reach of the same text, else zeros; and
    the number of windows of each text."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass").lower()
        counts[i] = n = -(-len(raw) // WINDOW)
        parts.append(raw.ljust(n * WINDOW, b"\0"))
    data = np.frombuffer(b"".join([*parts, bytes(REACH)]), np.uint8)
    wide = np.lib.stride_tricks.as_strided(data, (int(counts.sum()), WINDOW + REACH - 1), (WINDOW, 1)).copy()
    wide[np.cumsum(counts)[counts > 0] - 1, WINDOW:] = 0
    return wide, counts


def _unrolled(embedded: np.ndarray) -> np.ndarray:
    """(m * WINDOW, REACH * DIM): at each place of m windows the embeddings of it and the next REACH - 1 bytes."""
    m, wide, _ = embedded.shape
    view = np.lib.stride_tricks.as_strided(embedded, (m, WINDOW, REACH * DIM), (4 * DIM * wide, 4 * DIM, 4))
    return np.ascontiguousarray(view).reshape(m * WINDOW, REACH * DIM)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def window_probabilities(model: Model, wide: np.ndarray) -> np.ndarray:
    """(windows, languages) of the windows that stream() gives."""
    pooled = np.empty((len(wide), model.filters.shape[1]), np.float32)
    for at in range(0, len(wide), _BLOCK):
        some = wide[at : at + _BLOCK]
        pooled[at : at + _BLOCK] = (_unrolled(model.embed[some]) @ model.filters).reshape(len(some), WINDOW, -1).max(1)
    return _softmax(np.maximum(pooled + model.bias, 0) @ model.out + model.out_bias)


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score (the mean probability, 0 to 1) of each text; ``und`` and 0 where it has no letter."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
    if not known:
        return langs, scores
    data, counts = stream([texts[i] for i in known])
    p = window_probabilities(model, data)
    weight = _LETTERISH[data[:, :WINDOW]].sum(1) + 1e-3
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    mean = np.add.reduceat(p * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]
    best = mean.argmax(1)
    for k, i in enumerate(known):
        langs[i] = model.languages[best[k]]
        scores[i] = min(1.0, max(0.0, float(mean[k, best[k]])))
    return langs, scores


def train(windows: list[bytes], langs: list[str], epochs: int = 6, seed: int = 1, batch: int = 64, rate: float = 4e-3) -> Model | None:
    """Adam on the cross entropy. windows: up to WINDOW + REACH - 1 bytes each; shorter ones are padded."""
    if not windows:
        return None
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    wide = WINDOW + REACH - 1
    x = np.frombuffer(b"".join(w[:wide].ljust(wide, b"\0") for w in windows), np.uint8).reshape(-1, wide)
    rng = np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat(np.arange(REACH * DIM)[:, None] < w * DIM, FILTERS, 1) for w in WIDTHS], 1)
    m = Model(
        names, rng.normal(0, 0.5, (256, DIM)).astype("f4"), (rng.normal(0, 0.3, (REACH * DIM, n)) * mask).astype("f4"), np.zeros(n, "f4"),
        rng.normal(0, 0.3, (n, len(names))).astype("f4"), np.zeros(len(names), "f4"),
    )
    m.embed[0] = 0
    keys = ("embed", "filters", "bias", "out", "out_bias")
    first, second = ({k: np.zeros_like(getattr(m, k)) for k in keys} for _ in range(2))
    step = 0
    weight = np.bincount(y, minlength=len(names))
    weight = (len(y) / len(names) / np.maximum(weight, 1)).astype("f4")
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            b = x[own]
            u = _unrolled(m.embed[b]).reshape(len(b), WINDOW, -1)
            conv = u @ m.filters
            where = conv.argmax(1)
            pooled = np.take_along_axis(conv, where[:, None], 1)[:, 0] + m.bias
            act = np.maximum(pooled, 0)
            p = _softmax(act @ m.out + m.out_bias)
            d = p
            d[np.arange(len(own)), y[own]] -= 1
            d *= weight[y[own]][:, None] / len(own)
            grad = {"out": act.T @ d, "out_bias": d.sum(0)}
            back = (d @ m.out.T) * (pooled > 0)
            grad["bias"] = back.sum(0)
            seen = np.take_along_axis(u, where[:, :, None], 1)  # (batch, n, REACH * DIM)
            grad["filters"] = np.einsum("bnk,bn->kn", seen, back) * mask
            into = (back[:, :, None] * m.filters.T[None]).reshape(len(own), n, REACH, DIM)
            at_byte = b[np.arange(len(own))[:, None, None], where[:, :, None] + np.arange(REACH)]
            grad["embed"] = np.zeros_like(m.embed)
            np.add.at(grad["embed"], at_byte.reshape(-1), into.reshape(-1, DIM))
            grad["embed"][0] = 0
            step += 1
            for k in keys:
                first[k] += 0.1 * (grad[k] - first[k])
                second[k] += 0.001 * (grad[k] ** 2 - second[k])
                getattr(m, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def sample_windows(labelled: DataFrame, max_rows: int, windows: int, seed: int = 1) -> pd.DataFrame:
    """(lang, window) of about max_rows labelled rows, evenly over the languages, chosen by a hash of the id: a bounded
    sample, the same at every run. Windows lie at seeded places over the whole text; a third are cut short, so that
    short texts are learned too."""
    ids = labelled.select("doc_id", "lang").where("lang is not null")
    counts = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}  # as many rows as languages
    if not counts:
        return pd.DataFrame({"lang": [], "window": []})
    each = max(1, max_rows // len(counts))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(each / n)) for k, n in sorted(counts.items())])
    chosen = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (draw < share)).select("doc_id", "lang", "text")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, lang, text in frame.itertuples(index=False):
                raw = text.encode("utf-8", "surrogatepass").lower()
                rng = np.random.default_rng([seed, int(doc_id) & 0xFFFFFFFF if doc_id == doc_id and doc_id is not None else 0])
                for k in range(windows):
                    start = int(rng.integers(0, max(1, len(raw) - WINDOW + 1)))
                    size = int(rng.integers(8, 80)) if k % 3 == 2 else WINDOW + REACH - 1
                    out.append((lang, raw[start : start + size]))
            yield pd.DataFrame(out, columns=["lang", "window"])

    return chosen.mapInPandas(cut, "lang string, window binary").orderBy("lang", "window").limit(4 * max_rows * windows).toPandas()


#: First and last letter of scripts from which foreign windows are made.
_SCRIPTS = ((0x61, 0x7A), (0x61, 0x7A), (0x430, 0x44F), (0x3B1, 0x3C9), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3093), (0xAC00, 0xD7A3), (0x4E00, 0x9FA5), (0x4E00, 0x9FA5))


def foreign_windows(windows: list[bytes], number: int, seed: int = 1) -> list[bytes]:
    """Windows of no language that was learned: texts whose letters have changed places, and random words of many scripts."""
    rng = np.random.default_rng([seed, 2])
    wide = WINDOW + REACH - 1
    out = []
    for k in range(number):
        if k % 3 == 0 and windows:
            text = list(windows[int(rng.integers(len(windows)))].decode("utf-8", "ignore"))
            at = [i for i, c in enumerate(text) if c.isalpha()]
            if len(at) < 40:
                continue
            for i, j in zip(at, rng.permutation(at).tolist(), strict=True):
                text[i], text[j] = text[j], text[i]
        else:
            low, high = _SCRIPTS[int(rng.integers(len(_SCRIPTS)))]
            letters = rng.integers(low, high + 1, int(rng.integers(4, 300)))
            spaced = low < 0x3041 or low == 0xAC00
            text = []
            while len(text) < wide:
                text += [*map(chr, rng.choice(letters, int(rng.integers(1, 12)))), *(" " if spaced or rng.random() < 0.2 else "")]
        raw = "".join(text).encode()
        out.append(raw[: int(rng.integers(30, 100)) if k % 3 == 2 else wide])
    return out


def fit(labelled: DataFrame, max_rows: int = 2000, windows: int = 6, epochs: int = 6, seed: int = 1, reject: bool = False) -> Model | None:
    """Trains on about ``max_rows`` rows (doc_id, text, lang) of those given, ``windows`` windows of each. Rows without a
    text or label are passed over; without any, the model is None and every prediction ``und``. reject: ``und`` is learned
    as one more class, from foreign_windows."""
    sample = sample_windows(labelled, max_rows, windows, seed)
    kept = [(bytes(w), x) for w, x in zip(sample["window"], sample["lang"], strict=True) if _LETTERISH[np.frombuffer(w, np.uint8)].any()]
    if reject and kept:
        number = max(300, 2 * len(kept) // len({x for _, x in kept}))
        kept += [(w, UNKNOWN) for w in foreign_windows([w for w, _ in kept], min(number, len(kept)), seed)]
    return train([w for w, _ in kept], [x for _, x in kept], epochs, seed)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs and two columns, lang_pred and score, from the text alone (columns of those names are replaced).

    Null text, or one without a letter: ``und`` and 0. Empty table: no rows. Repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some kB, whatever the input

    @F.pandas_udf("lang_pred string, score double")
    def found(texts: pd.Series) -> pd.DataFrame:
        made = [predict(shared.value, some) for some in in_blocks(texts)]
        return pd.DataFrame({"lang_pred": [x for langs, _ in made for x in langs], "score": [x for _, scores in made for x in scores]})

    both = docs.withColumn("_found", found(F.col("text").cast("string")))
    return both.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def held_out(key: str = "doc_id"):
    """Whether the id's hash falls into the held-out fifth; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0
