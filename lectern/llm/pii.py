"""Personal data: base rules, and a skip-chain conditional random field.

The field's nodes are a document's mentions: runs of digits and their
separators, and strings with an at sign (or "at" and "dot" written out). Each
mention has a label, none or a kind. Unary potentials come from its shape and
the word before it; neighbours in the text share a chain potential; mentions
with the same or similar key (the digits; the local part of an address), however
far apart, share a skip potential. Mentions that a base rule accepts are clamped
to its kind. Loopy sum-product message passing then makes labels of an entity
consistent in its document, and a mention whose posterior passes a threshold is
added to the base spans, which always stay.

Weights are learned from documents in which some base mentions are hidden: the
rules give the labels, and the field must recover them from shape, context and
the mentions that are still seen. All three tables are as fitted; the skip table
is diagonal and not negative.

Skip edges join each mention to the next one with its key, so a token repeated
n times has n - 1 edges, and messages cost time in proportion to mentions.

Defined results: null text is empty and has no spans; repeated rows are scanned
each; an empty table learns nothing and returns no rows. Further input columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import hash_sample

# The base rules, kinds in their order. What precedes an address's sign is found from
# the sign backwards, and no run of digits is entered twice, so long runs cost time in proportion.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What can be a mention beyond the base rules: addresses, also written out, and digits.
#: Shapes of a whole telephone or card number come first, so that numbers which
#: stand side by side (where a base rule takes both for one and drops it) are two mentions.
SIGN = re.compile(r"@| ?[(\[][aA][tT][)\]] ?")
HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[(\[][dD][oO][tT][)\]] ?)[A-Za-z0-9-]++)*+")
NUMBER = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"|[0-9]{4}(?:[ -][0-9]{4}){2}(?:[ -][0-9]{1,4})?"
    r"|[0-9]{12,19}"
    r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
    r"|\+?[0-9](?:[\x20.-]?[0-9]){6,}"
    r")(?![A-Za-z0-9])"
)
CONTEXT = ("call", "phone", "tel", "mobile", "mail", "email", "contact", "card", "visa", "account", "ip", "address", "host", "server")
_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9\n]{1,4}\Z")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if at % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def addresses(text: str, sign: re.Pattern, host: re.Pattern) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping places of local characters, a sign and a host, in linear time.

    No local character is a sign, so the run before a sign belongs to it alone.
    """
    free = 0
    for m in sign.finditer(text):
        if m.start() < free:
            continue
        before = text[free : m.start()]
        start = free + len(before.rstrip(LOCAL))
        end = host.match(text, m.end()) if start < m.start() else None
        free = end.end() if end else m.end()
        if end:
            yield start, free


def _byte(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


_AT = re.compile("@")


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, sorted by start, then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", start, end) for start, end in addresses(text, _AT, DOMAIN)]
    if re.search("[0-9]", text):
        # no part of a match has to be below 256 for it to be one, but above it drops the match
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


NODE_FEATURES = 12 + len(CONTEXT)
#: Features that base rules test: at sign, plus sign, three dots, checksum.
TESTED = (1, 3, 5, 8)
#: What a second mention need not share: those, what else a way of writing shows (parentheses, digits in
#: groups of three and four, in fours), and the word before.
FORM = (*TESTED, 4, 9, 11, *range(12, NODE_FEATURES))
LABELS = len(KINDS) + 1


@dataclass
class Mention:
    start: int
    end: int
    key: str
    features: np.ndarray
    label: int  # of the base rules: 0 none, else the kind's place + 1


def _similar_key(text: str) -> str:
    """The same for spellings of one entity: last ten digits, or the address without separators."""
    low = text.lower()
    if "@" in text or re.search(r"[(\[]at[)\]]", low):
        low = re.sub(r" ?[(\[]at[)\]] ?", "@", low)
        return "a:" + low.split("@")[0]
    if text.count(".") == 3 and IP.fullmatch(text):
        return "i:" + text
    digits = _digits(text)
    return "d:" + (digits if len(digits) > 11 else digits[-10:])


def mentions(text: str, base: list[Span]) -> list[Mention]:
    """Mentions in order; base spans are mentions whatever the pattern says."""
    spans = {(s, e): KINDS.index(k) + 1 for k, s, e in reversed(base)}
    taken = sorted(spans)
    low = text.lower()
    written = addresses(text, SIGN, HOST) if "@" in text or "(at)" in low or "[at]" in low else ()
    numbers = (m.span() for m in NUMBER.finditer(text)) if re.search("[0-9]", text) else ()
    for places in (written, numbers):
        at = 0
        for start, end in places:
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at == len(taken) or taken[at][0] >= end:
                spans.setdefault((start, end), 0)
    out = []
    for (start, end), label in sorted(spans.items()):
        own = text[start:end]
        digits = _digits(own)
        before = _BEFORE.search(text[max(0, start - 40) : start])
        word = before[1].lower() if before else ""
        feature = np.zeros(NODE_FEATURES)
        feature[0] = 1
        feature[1] = "@" in own
        feature[2] = bool(re.search(r"[(\[]at[)\]]", own.lower()))
        feature[3] = own.startswith("+")
        feature[4] = "(" in own
        feature[5] = own.count(".") == 3
        feature[6] = 7 <= len(digits) <= 11
        feature[7] = 12 <= len(digits) <= 19
        feature[8] = 12 <= len(digits) <= 19 and luhn(digits)
        feature[9] = bool(re.search(r"[0-9]{3}[ .-][0-9]{4}\Z", own))
        feature[10] = len(digits) == len(own)
        feature[11] = bool(re.search(r"[0-9]{4}([ -][0-9]{4}){2}", own))
        if word in CONTEXT:
            feature[12 + CONTEXT.index(word)] = 1
        out.append(Mention(start, end, _similar_key(own), feature, label))
    return out


def edges(nodes: list[Mention]) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between neighbours and skip edges to the next mention with the same key."""
    chain = np.array([(i, i + 1) for i in range(len(nodes) - 1)], dtype=np.int64).reshape(-1, 2)
    last: dict[str, int] = {}
    skip = []
    for i, node in enumerate(nodes):
        if node.key in last:
            skip.append((last[node.key], i))
        last[node.key] = i
    return chain, np.array(skip, dtype=np.int64).reshape(-1, 2)


@dataclass
class Field:
    """Weights: features x labels, and two symmetric label x label tables."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def posterior(self, nodes: list[Mention], clamped: np.ndarray, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
        """Marginals of each mention's label by loopy sum-product; ``clamped``: label, or -1."""
        n = len(nodes)
        unary = np.stack([m.features for m in nodes]) @ self.node
        known = clamped >= 0
        unary[known] = -50.0
        unary[known, clamped[known]] = 0.0
        chain, skip = edges(nodes)
        pairs = np.concatenate((chain, skip))
        tables = np.concatenate((np.repeat(self.chain[None], len(chain), axis=0), np.repeat(self.skip[None], len(skip), axis=0)))
        source, target = np.concatenate((pairs[:, 0], pairs[:, 1])), np.concatenate((pairs[:, 1], pairs[:, 0]))
        tables = np.concatenate((tables, tables.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))))
        message = np.zeros((len(source), LABELS))
        for _ in range(rounds if len(pairs) else 0):
            belief = unary.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            new = _log_sum(out[:, :, None] + tables, axis=1)
            new -= _log_sum(new, axis=1)[:, None]
            message, moved = (1 - damping) * new + damping * message, np.abs(new - message).max()
            if moved < 1e-3:
                break
        belief = unary.copy()
        np.add.at(belief, target, message)
        belief -= _log_sum(belief, axis=1)[:, None]
        return np.exp(belief).reshape(n, LABELS)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def fit(documents: list[list[Mention]], hidden: float = 0.5, rounds: int = 1500, rate: float = 1.0, ridge: float = 1e-3, seed: int = 3) -> Field:
    """Pseudo-likelihood: each mention's label given its features and its neighbours' labels.

    Of a hidden mention the features that its rule tests are dropped, so that
    the field learns how far the word before it and its neighbours tell its
    kind. A hidden mention of a kind also stands for a second mention of its
    entity in a form that no rule knows (bare digits, an address written out):
    of that kind beside a seen mention, and of none in a text without one. This
    is what skip weights are learned from, besides what texts repeat themselves.
    """
    rng = np.random.default_rng(seed)
    feats, labels, chain_sum, skip_sum = [], [], [], []
    for nodes in documents:
        own = np.array([m.label for m in nodes], dtype=np.int64)
        chain, skip = edges(nodes)
        around = np.zeros((2, len(nodes), LABELS))
        for which, pairs in enumerate((chain, skip)):
            if len(pairs):
                np.add.at(around[which], pairs[:, 0], np.eye(LABELS)[own[pairs[:, 1]]])
                np.add.at(around[which], pairs[:, 1], np.eye(LABELS)[own[pairs[:, 0]]])
        x = np.stack([m.features for m in nodes])
        unseen = rng.random(len(nodes)) < hidden
        again = unseen & (own > 0)
        other = np.where(np.isin(np.arange(NODE_FEATURES), FORM), 0, x[again])
        other[:, 2], other[:, 10] = x[again][:, 1], 1 - x[again][:, 1]
        feats += [np.where(unseen[:, None] & np.isin(np.arange(NODE_FEATURES), TESTED), 0, x), other, other]
        labels += [own, own[again], np.zeros(len(other), dtype=np.int64)]
        chain_sum += [around[0], np.zeros((2 * len(other), LABELS))]
        skip_sum += [around[1], np.eye(LABELS)[own[again]], np.zeros((len(other), LABELS))]
    node, chain_w, skip_w = np.zeros((NODE_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    if not feats:
        node[0, 0] = 2.0
        return Field(node, chain_w, skip_w)
    x, y = np.concatenate(feats), np.concatenate(labels)
    c, s = np.concatenate(chain_sum), np.concatenate(skip_sum)
    target = np.eye(LABELS)[y]
    n = len(y)
    tables = [node, chain_w, skip_w]
    agree = np.diag([0.0] + [1.0] * len(KINDS))
    moved = [np.full(t.shape, 1e-9) for t in tables]  # squared steps so far: what is seldom seen steps as far as the rest
    for _ in range(rounds):
        score = x @ node + c @ chain_w + s @ skip_w
        error = target - np.exp(score - _log_sum(score, axis=1)[:, None])
        slopes = (x.T @ error / n, (c.T @ error + error.T @ c) / (2 * n), (s.T @ error + error.T @ s) / (2 * n))
        for table, slope, far in zip(tables, slopes, moved, strict=True):
            step = slope - ridge / n * table
            far += step * step
            table += rate * step / np.sqrt(far)
        # mentions of one entity agree: a skip edge never speaks for different kinds, and none for no kind,
        # as the rules' labels say nothing of what the rules miss
        skip_w *= agree
        np.maximum(skip_w, 0, out=skip_w)
    return Field(*tables)


def _drawn(nodes: list[Mention], text: str, most: int) -> list[Mention]:
    """Neighbouring mentions of a text, ``most`` at most, from a place that its hash gives."""
    start = zlib.crc32(text.encode()) % max(1, len(nodes) - most + 1)
    return nodes[start : start + most]


def train(docs: DataFrame, documents: int = 4000, most: int = 64) -> Field:
    """Learn from about ``documents`` texts with a digit or an at sign at most, taken by hash.

    Mentions are found on the executors; the driver gets the features, a few
    hundred bytes each, of ``most`` neighbouring ones of a text at most.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").alias("doc_id")).where(F.col("text").rlike("[0-9@]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                nodes = _drawn(mentions(text, base_spans(text)), text, most)
                if nodes:
                    rows.append(([m.key for m in nodes], [m.label for m in nodes], np.concatenate([m.features for m in nodes]).tolist()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.list_(pa.string())), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.list_(pa.float64()))], ["keys", "labels", "features"])

    found = hash_sample(texts, documents, "doc_id", "text").select("text").mapInArrow(run, "keys array<string>, labels array<long>, features array<double>").toPandas()
    made = []
    for keys, labels, feature in zip(found["keys"], found["labels"], found["features"], strict=True):
        rows = np.asarray(feature, dtype=float).reshape(len(keys), NODE_FEATURES)
        made.append([Mention(0, 0, k, f, int(label)) for k, label, f in zip(keys, labels, rows, strict=True)])
    made.sort(key=lambda nodes: [(m.key, m.label) for m in nodes])
    return fit(made)


def all_spans(text: str, field: Field, threshold: float = 0.9) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the field adds."""
    base = base_spans(text)
    nodes = mentions(text, base)
    if not any(m.label == 0 for m in nodes):
        return base, []
    clamped = np.array([m.label or -1 for m in nodes])
    posterior = field.posterior(nodes, clamped)
    added = []
    for node, p in zip(nodes, posterior, strict=True):
        best = int(p.argmax())
        if not node.label and best and p[best] >= threshold:
            added.append((KINDS[best - 1], node.start, node.end))
    return base, added


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _by_place(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, field: Field, threshold: float = 0.9) -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, added = all_spans(text or "", field, threshold)
                kinds = [s[0] for s in base]
                rows.append((doc_id, *(kinds.count(k) for k in KINDS), hashlib.sha256(digest(base).encode()).hexdigest(), digest(_by_place(base + added))))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def masked(text: str, field: Field, threshold: float = 0.9) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    base, added = all_spans(text, field, threshold)
    out, at = [], 0
    for kind, start, end in _by_place(base + added):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, field: Field, threshold: float = 0.9) -> DataFrame:
    """``docs`` with personal data masked in text; null stays null, all other columns are kept.

    ``n_chars`` follows the new text where there is such a column.
    """
    schema = docs.schema
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t is None else masked(t, field, threshold) for t in batch.column(text_at).to_pylist()]
            columns = list(batch.columns)
            columns[text_at] = pa.array(new, batch.schema.field(text_at).type)
            if "n_chars" in batch.schema.names:
                at = batch.schema.names.index("n_chars")
                columns[at] = pa.array([None if t is None else len(t) for t in new], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
