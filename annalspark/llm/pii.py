"""Personal data: exact base patterns, extended by a skip-chain conditional random field.

Base spans (email, ip, card, phone) are found by fixed patterns over the whole text and always stay.  A skip-chain CRF
then labels the looser candidates of each document (numbers and addresses that the patterns miss): neighbours share a
chain potential, repeated or similar tokens share a skip potential wherever they stand, and loopy belief propagation
carries a label from a sure mention to the unsure ones.  Skip edges join each mention to the previous one of the same
normal form, so their number is linear in the mentions.

All weights (emissions, chain and skip) are trained together by maximum pseudo-likelihood with a Gaussian prior, on the
candidates of at most `sample_docs` documents (a hash sample), labelled by the base patterns: every mention is predicted
from its own features and from the labels of its neighbours on chain and skip edges.  A loose mention that repeats a base
one has no label there (it is what the field is to find): it is left out of the training, with its edges.

Cases: a null text is an empty one and has no spans; a null id is passed on; repeated rows give repeated results; an
empty table gives no rows; extra columns are ignored (`redact` passes them on); very long texts are searched whole, in
time linear in their length.  Ties: spans of equal start are ordered by kind; among loose candidates that overlap, the
first pattern wins, then the leftmost; a mention whose best two labels are equally likely is not added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import place_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Loose candidates, in order of precedence: international numbers and card numbers that a longer run of digits hides
#: from the base patterns, spelled-out addresses, and any digit groups with usual separators.
_LOOSE_PHONE = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9])(?:(?:[0-9]{4}[\x20-]){3}[0-9]{4}|[0-9]{12,19})(?![0-9])")
_LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9][0-9().\x20/-]{5,}[0-9](?![0-9A-Za-z])")
_LOOSE_MAIL = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20|@)\x20?[A-Za-z0-9-]{1,64}(?:(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?|\.)[A-Za-z0-9-]{1,64})+")
_CUES = (
    ("email", re.compile(r"e-?mail|mail|contact|write", re.I)),
    ("ip", re.compile(r"\bip\b|address|host|server|login from", re.I)),
    ("card", re.compile(r"card|visa|credit|payment|account", re.I)),
    ("phone", re.compile(r"phone|tel|call|fax|mobile|cell|whatsapp", re.I)),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, leftmost and non-overlapping per kind, in order."""
    found: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            found.append((lo, m.end(), 0))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), 3))
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def _apart(taken: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the new spans that meet none of the taken ones; both in order, the new ones disjoint."""
    out, k, reach = [], 0, 0
    for a, b in new:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label): base spans with their label, and loose spans outside them with label 0, in order."""
    out = [(a, b, k + 1) for a, b, k in base]
    spans = sorted((a, b) for a, b, _ in base)
    loose: list[tuple[int, int]] = []
    if _DIGIT.search(text):
        loose += _apart(spans, [m.span() for m in _LOOSE_PHONE.finditer(text)] if "+" in text else [])
        loose += _apart(sorted([*spans, *loose]), [m.span() for m in _LOOSE_CARD.finditer(text)])
    if "@" in text or "(at)" in text or "[at]" in text or " at " in text and (" dot " in text or "(dot)" in text or "[dot]" in text):
        loose += _apart(sorted([*spans, *loose]), [m.span() for m in _LOOSE_MAIL.finditer(text)])
    if _DIGIT.search(text):
        loose += _apart(sorted([*spans, *loose]), [m.span() for m in _LOOSE_NUMBER.finditer(text)])
    out += [(a, b, 0) for a, b in loose]
    out.sort()
    return out


N_FEATURES = 16


def emission(text: str, a: int, b: int) -> np.ndarray:
    """Features of one candidate."""
    span = text[a:b]
    digits = [c for c in span if "0" <= c <= "9"]
    n = len(digits)
    parts = span.split(".")
    before = text[max(0, a - 24) : a]
    f = np.zeros(N_FEATURES)
    f[0] = 1
    f[1] = "@" in span
    f[2] = "at" in span and n < len(span) / 2
    f[3] = len(parts) == 4 and all(p.isdigit() and int(p) <= 255 for p in parts if len(p) < 6) and all(p.isdigit() and len(p) < 6 for p in parts)
    f[4] = span.startswith("+")
    f[5] = "(" in span or ")" in span
    f[6] = 9 <= n <= 15
    f[7] = 12 <= n <= 19
    f[8] = n == 16
    f[9] = 12 <= n <= 19 and luhn("".join(digits))
    f[10] = n == len(span)
    f[11] = " " in span or "-" in span
    for i, (_, cue) in enumerate(_CUES):
        f[12 + i] = cue.search(before) is not None
    return f


def _normal(text: str, a: int, b: int) -> str:
    """What repeated mentions have in common: the last digits of a number, or the letters of an address."""
    span = text[a:b].lower()
    digits = re.sub(r"[^0-9]", "", span)
    if len(digits) * 2 >= sum(c.isalnum() for c in span):
        return digits[-10:]
    return re.sub(r"[^a-z0-9]", "", span.replace("(at)", "").replace("[at]", "").replace(" at ", "").replace("(dot)", "").replace("[dot]", "").replace(" dot ", ""))


@dataclass
class CrfModel:
    """Emission weights (features by labels) and the weights of equal labels on chain and skip edges: centres of the prior."""

    emission: np.ndarray
    chain: float = 0.0
    skip: float = 6.0
    rounds: int = 12
    threshold: float = 0.9


def prior_weights() -> np.ndarray:
    """Centre of the Gaussian prior: what the shapes of the four kinds suggest."""
    w = np.zeros((N_FEATURES, len(LABELS)))
    w[0] = [2.0, -2.0, -2.0, -2.0, -2.0]
    w[1, 1], w[2, 1], w[12, 1] = 4.0, 1.0, 1.0
    w[3, 2], w[13, 2] = 4.0, 1.0
    w[9, 3], w[8, 3], w[14, 3] = 6.0, 1.0, 1.0
    w[4, 4], w[5, 4], w[6, 4], w[15, 4] = 5.0, 1.5, 1.0, 1.0
    return w


def neighbours(labels: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """How many neighbours of each node have each label, over the edges `pairs`."""
    seen = np.zeros((len(labels), len(LABELS)))
    for a, b in ((0, 1), (1, 0)):
        np.add.at(seen, (pairs[:, a], labels[pairs[:, b]]), 1)
    return seen


def train(features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 200, spread: float = 1.0) -> CrfModel:
    """Maximum pseudo-likelihood weights with a Gaussian prior; chain and skip are the edges, as pairs of node numbers."""
    start = CrfModel(prior_weights())
    unsure = (labels == 0) & (neighbours(labels, skip)[:, 1:].sum(1) > 0)
    chain, skip = (pairs[~unsure[pairs].any(1)] for pairs in (chain, skip))
    w, edge = start.emission.copy(), np.array([start.chain, start.skip])
    if len(labels):
        truth = np.eye(len(LABELS))[labels]
        sure = ~unsure[:, None]
        near = [neighbours(labels, chain), neighbours(labels, skip)]
        size = (features**2).sum(1) + near[0].sum(1) ** 2 + near[1].sum(1) ** 2
        rate = 1.0 / max(1.0, 0.25 * float(size.mean()))
        pull = spread * max(len(labels), 50)
        for _ in range(steps):
            z = features @ w + edge[0] * near[0] + edge[1] * near[1]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p = np.where(sure, p, truth)
            w += rate * (features.T @ (truth - p) / len(labels) - (w - start.emission) / pull)
            edge += rate * (np.array([((truth - p) * x).sum() for x in near]) / len(labels) - (edge - [start.chain, start.skip]) / pull)
    return CrfModel(w, float(edge[0]), float(edge[1]))


def edges(text: str, nodes: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges of near neighbours and skip edges of repeated or similar mentions."""
    chain = [(i - 1, i) for i in range(1, len(nodes)) if nodes[i][0] - nodes[i - 1][1] <= 40]
    last: dict[str, int] = {}
    skip = []
    for i, (a, b, _) in enumerate(nodes):
        form = _normal(text, a, b)
        if len(form) >= 6:
            if form in last:
                skip.append((last[form], i))
            last[form] = i
    return chain, skip


def propagate(unary: np.ndarray, pairs: list[tuple[int, int, float]], rounds: int) -> np.ndarray:
    """Marginals by loopy belief propagation with equal-label potentials; damped, in fixed order."""
    if not pairs:
        z = np.exp(unary - unary.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)
    u = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
    v = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
    gain = np.expm1(np.array([p[2] for p in pairs] * 2))[:, None]
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    msg = np.zeros((len(u), unary.shape[1]))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, v, msg)
        out = total[u] - msg[back]
        p = np.exp(out - out.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = np.log1p(gain * p)
        new -= new.mean(1, keepdims=True)
        if np.abs(new - msg).max() < 1e-4:
            msg = new
            break
        msg = 0.5 * msg + 0.5 * new
    total = unary.copy()
    np.add.at(total, v, msg)
    z = np.exp(total - total.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def find(text: str, model: CrfModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans (base ones and those the field adds), both in order of start, then kind."""
    base = base_spans(text)
    nodes = candidates(text, base)
    if len(nodes) == len(base):
        return base, base
    x = np.array([emission(text, a, b) for a, b, _ in nodes])
    unary = x @ model.emission
    for i, (_, _, label) in enumerate(nodes):
        if label:
            unary[i] = -30.0
            unary[i, label] = 30.0
    chain, skip = edges(text, nodes)
    pairs = [(i, j, model.chain) for i, j in chain] + [(i, j, model.skip) for i, j in skip]
    p = propagate(unary, pairs, model.rounds)
    added = [(a, b, int(p[i].argmax()) - 1) for i, (a, b, label) in enumerate(nodes) if not label and p[i].argmax() and p[i].max() >= model.threshold]
    return base, sorted([*base, *added], key=lambda s: (s[0], s[2], s[1]))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def fit(docs: DataFrame, sample_docs: int = 2000) -> CrfModel:
    """Trains on the candidates of about `sample_docs` documents, a hash sample; never on more than four times as many."""
    n = docs.count()
    some = docs.select(F.col("text"), F.xxhash64("doc_id", "text", F.lit(7)).alias("h"))
    if n > sample_docs:
        some = some.filter(F.pmod("h", F.lit(1_000_000)) < max(1, int(1_000_000 * sample_docs / n))).limit(4 * sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                nodes = candidates(text or "", base_spans(text or ""))
                if nodes:
                    feats = b"".join(emission(text, a, b).tobytes() for a, b, _ in nodes)
                    rows.append((h, feats, np.array([y for *_, y in nodes], np.int8).tobytes(), *(np.array(e, np.int32).tobytes() for e in edges(text, nodes))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["h", "x", "y", "chain", "skip"])

    rows = some.select("text", "h").mapInArrow(run, "h long, x binary, y binary, chain binary, skip binary").collect()  # bounded by sample_docs
    rows.sort(key=lambda r: (r["h"], bytes(r["x"])))  # the fit does not depend on the order of tasks
    x = np.concatenate([np.zeros((0, N_FEATURES)), *(np.frombuffer(r["x"]).reshape(-1, N_FEATURES) for r in rows)])
    y = np.concatenate([np.zeros(0, np.int8), *(np.frombuffer(r["y"], np.int8) for r in rows)]).astype(int)
    first = np.cumsum([0, *(len(r["y"]) for r in rows)])
    chain, skip = (np.concatenate([np.zeros((0, 2), int), *(np.frombuffer(r[k], np.int32).reshape(-1, 2) + at for r, at in zip(rows, first, strict=False))]) for k in ("chain", "skip"))
    return train(x, y, chain, skip)


def detect(docs: DataFrame, model: CrfModel | None = None) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every document."""
    crf = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros((4, batch.num_rows), np.int64)
            hashes, spans = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                base, every = find(text or "", crf)
                for *_, k in base:
                    n[k, i] += 1
                hashes.append(hashlib.sha256(digest(base).encode()).hexdigest())
                spans.append(digest(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in n), pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: CrfModel | None = None) -> DataFrame:
    """The documents with their personal data masked; `n_chars` follows the text where both are present."""
    crf = model or fit(docs)
    names, schema = docs.columns, docs.schema
    at = place_of(docs, "text")
    size = next((k for k, f in enumerate(schema) if f.name.lower() == "n_chars" and f.dataType.typeName() in ("long", "integer")), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = batch.column(at).to_pylist(), batch.column(size).to_pylist() if size is not None else []
            for i, text in enumerate(texts):
                if text and (spans := find(text, crf)[1]):
                    texts[i] = mask(text, spans)
                    if sizes:
                        sizes[i] = len(texts[i])
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.column(at).type)
            if sizes:
                cols[size] = pa.array(sizes, batch.column(size).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, schema)
