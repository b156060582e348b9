"""Personal data: exact patterns, and a skip-chain conditional random field over the tokens that look like data.

Tokens with a digit or an at sign are the nodes.  Each has features of its own shape and its neighbours; tokens
next to each other share a chain potential; tokens that repeat or resemble an earlier one of the same document
(equal last digits, or equal letters around an at sign) share a skip potential with the nearest such one, however
far away.  Labels are the kinds, or none.  Loopy sum-product message passing over the document's graph lets a
clear mention carry its label to the unclear ones.

Potentials are learned by pseudo-likelihood from a bounded sample of texts (at most ``SAMPLE`` texts and
``SAMPLE_TOKENS`` tokens, texts chosen by md5), with some features hidden at random.  Labels come from three sources.
Tokens in exact spans have their kind, others none; tokens of a match that failed for having too many digits, where
two data ran into one, have no label.  And since the exact patterns say nothing of what they miss, each sampled span
is also spelled in a way that they don't match (``spelled``), next to the words around it: behind its clear mention,
labelled with its kind, and with other digits or letters, labelled none.  So the spelling alone is no evidence, and
the link to a clear mention is.  Tokens of the given texts that may be data but match no pattern have no label either.

The exact spans always stay.  Runs of neighbouring tokens that the field labels with one kind at ``SURE`` or more
are added if they keep to the kind's characters and number of digits and overlap no span.

Scale.  Scoring is one scan by a vectorised function that holds the weights (under 1 MB) and one batch; texts
without a digit or an at sign cost a search for those characters.  All graphs of a batch are one graph of
separate parts.  Only the sample is shuffled.  Patterns and links are linear in the text: each token has at most
one skip link back.

Defined results: null text is the empty text; repeated rows get equal results; an empty table gives an empty
result; without anything to learn from no span is added.  Extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import spans_digest, table, text_or_empty

# The contract's kinds and patterns (written so that they take linear time).
KINDS = {k: i for i, k in enumerate(("email", "ip", "card", "phone"))}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

SAMPLE, SAMPLE_TOKENS = 2000, 200_000
BITS = 14
SURE = 0.5
#: Log-odds of a known label.
CERTAIN = 30.0
#: Stands for no label.
UNKNOWN = 255
STILL = 1e-5
N = len(KINDS) + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each at sign with all local characters before it, as far back as the last match's end."""
    past = 0
    at = text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at):
            s = at
            while s > past and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                yield s, m.end()
                past = m.end()
        at = text.find("@", max(at + 1, past))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if any(d in text for d in "0123456789"):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(_small, m.groups()))]
        for m in CARD.finditer(text):
            if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def run_together(text: str) -> list[tuple[int, int]]:
    """Matches that have more digits than their kind takes."""
    found = [m.span() for pattern, most in ((CARD, 19), (PHONE, 15)) for m in pattern.finditer(text) if len(_digits(m[0])) > most]
    return found if any(d in text for d in "0123456789") else []


def spelled(kind: str, span: str) -> str:
    """``span`` in a form that the exact patterns don't match."""
    if kind == "email":
        return span.split("@")[0] + "@" + span.split("@")[1].split(".")[0]
    if kind == "ip":
        return span.replace(".", "-")
    digits = _digits(span)
    if kind == "card":
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}".lstrip("-")


def _other(span: str) -> str:
    """Something of the same form."""
    return "".join(chr((ord(c) - 48 + 3) % 10 + 48) if "0" <= c <= "9" else chr((ord(c) - 97 + 7) % 26 + 97) if "a" <= c <= "z" else c for c in span)


def lessons(text: str) -> Iterator[tuple[str, list[tuple[int, int, str]], list[tuple[int, int]] | None]]:
    """Texts that ``text`` teaches, with their labelled spans, and the places that have no label."""
    base, silent = base_spans(text), run_together(text)
    yield text, base, silent
    if not base:
        return
    hidden, made, size, labels = {}, [text], len(text), list(base)
    alone: list[str] = []
    for s, e, kind in base:
        before, after = text[:s].split()[-2:], text[e:].split(maxsplit=2)[:2]
        form = hidden.setdefault((kind, text[s:e]), spelled(kind, text[s:e]))
        left = "\n" + "".join(w + " " for w in before)
        labels.append((size + len(left), size + len(left) + len(form), kind))
        made += [left, form, "".join(" " + w for w in after)]
        size += sum(map(len, made[-3:]))
        alone += [*before, _other(form), *after]
    yield "".join(made), labels, silent
    yield " ".join(alone), [], None


def _shape(word: str) -> str:
    word = re.sub(r"[0-9]+", "9", word)
    return re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", word))


def _link(word: str) -> str | None:
    """What repeated or similar tokens have in common: the last digits, or what stands before an at sign."""
    if "@" in word:
        return "@" + word.strip(_EDGE).split("@")[0].lower()
    digits = _digits(word)
    return digits[-7:] if len(digits) >= 4 else None


def _feature(name: str, value) -> int:
    return zlib.crc32(f"{name}={value}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


FEATURES = 11
#: Stands around data without being part of it.
_EDGE = ".,;:()<>\"'"


class Graph:
    """Nodes of one or more texts: features, chain and skip edges, places."""

    def __init__(self):
        self.features: list[list[int]] = []
        self.spans: list[tuple[int, int, int]] = []  # text, start, end
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, row: int, text: str) -> None:
        if not any(c in text for c in "0123456789@"):
            return
        words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        data = re.compile(r"[0-9@]").search
        last: dict[str, int] = {}
        before = -2
        for i, (s, e) in enumerate(words):
            word = text[s:e]
            if not data(word):
                continue
            node = len(self.spans)
            left = text[slice(*words[i - 1])] if i else ""
            right = text[slice(*words[i + 1])] if i + 1 < len(words) else ""
            core = word.strip(_EDGE)
            digits = _digits(word)
            values = ("b", _shape(word), _shape(left), _shape(right), left.lower(), right.lower(), _shape(core), (min(len(digits), 20), "@" in word), _shape(word[0]), (word.count("."), word.count("-"), "+" in word), 12 <= len(digits) <= 19 and luhn(digits))
            self.features.append([_feature(str(k), v) for k, v in enumerate(values)])
            self.spans.append((row, s, e))
            if chained := before == i - 1:
                self.chain.append((node - 1, node))
            before = i
            if (key := _link(word)) is not None:
                if key in last and not (chained and last[key] == node - 1):
                    self.skip.append((last[key], node))
                last[key] = node

    def labels(self, text: str, spans: list[tuple[int, int, str]], silent: list[tuple[int, int]] | None) -> list[int]:
        """Of the nodes of a graph of one text.

        Where patterns gave the spans, they are silent about the places in ``silent`` and about other tokens that
        may be data (``fits``): those have no label.  Without ``silent`` all that is outside the spans is none.
        """
        out = []
        for _, s, e in self.spans:
            kind = next((KINDS[k] + 1 for a, b, k in spans if a < e and s < b), 0)
            unsure = silent is not None and not kind and (any(a < e and s < b for a, b in silent) or fits(text[s:e].strip(_EDGE)))
            out.append(UNKNOWN if unsure else kind)
        return out


class Model:
    """Weights of features, chain and skip potentials."""

    def __init__(self):
        self.w, self.chain, self.skip = np.zeros((1 << BITS, N)), np.zeros((N, N)), np.zeros((N, N))

    def fit(self, features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 120, rate: float = 0.5) -> None:
        """Pseudo-likelihood by AdaGrad; a third of the features of each node is hidden at random in every step."""
        rng, n = np.random.default_rng(7), len(labels)
        told = labels != UNKNOWN
        one = np.eye(N)[np.where(told, labels, 0)] * told[:, None]
        totals = [np.full_like(x, 1e-8) for x in (self.w, self.chain, self.skip)]
        for _ in range(steps):
            shown = rng.random(features.shape) > 1 / 3
            logits = (self.w[features] * shown[:, :, None]).sum(axis=1)
            for edges, p in ((chain, self.chain), (skip, self.skip)):
                np.add.at(logits, edges[:, 0], one[edges[:, 1]] @ p.T)
                np.add.at(logits, edges[:, 1], one[edges[:, 0]] @ p)
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            err = (e / e.sum(axis=1, keepdims=True) - one) * told[:, None]
            gw = np.zeros_like(self.w)
            for k in range(N):
                gw[:, k] = np.bincount(features.ravel(), weights=(err[:, k : k + 1] * shown).ravel(), minlength=1 << BITS)
            grads = [gw / n + 1e-6 * self.w]
            for edges, p in ((chain, self.chain), (skip, self.skip)):
                g = err[edges[:, 0]].T @ one[edges[:, 1]] + one[edges[:, 0]].T @ err[edges[:, 1]]
                grads.append(g / n + 1e-4 * p)
            # A node has many features and few edges, so edges move faster.
            for x, g, t, pace in zip((self.w, self.chain, self.skip), grads, totals, (rate / 4, rate, rate), strict=True):
                t += g * g
                x -= pace * g / np.sqrt(t)

    def marginals(self, graph: Graph, known: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product over the chain and skip edges, damped by half, until messages move by ``STILL`` at most.

        Nodes whose label is ``known`` (0: not known) are evidence.

        A round passes on only what has moved.  Should messages of a loop never rest, rounds end when any of them
        could have crossed the largest text several times.
        """
        unary = self.w[np.array(graph.features)].sum(axis=1)
        if known is not None:
            unary = np.where(known[:, None] > 0, CERTAIN * np.eye(N)[known], unary)
        a = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
        if len(a):
            pair = np.concatenate([np.repeat(self.chain[None], len(graph.chain), 0), np.repeat(self.skip[None], len(graph.skip), 0)])
            src, dst = np.concatenate([a[:, 0], a[:, 1]]), np.concatenate([a[:, 1], a[:, 0]])
            pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            message, unary = np.zeros((len(src), N)), unary.copy()
            live = np.arange(len(src))
            for _ in range(100 + 4 * int(np.unique([r for r, _, _ in graph.spans], return_counts=True)[1].max())):
                x = (unary[src[live]] - message[back[live]])[:, :, None] + pair[live]
                new = np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)) + x.max(axis=1)
                step = 0.5 * (new - new.mean(axis=1, keepdims=True) - message[live])
                message[live] += step
                np.add.at(unary, dst[live], step)
                moved = live[np.abs(step).max(axis=1) > STILL]
                if not len(moved):
                    break
                told = np.zeros(len(unary), bool)
                told[dst[moved]] = True
                again = told[src]
                again[moved] = True
                live = np.flatnonzero(again)
        e = np.exp(unary - unary.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


_FIT = {
    1: lambda t: 0 < t.find("@") < len(t) - 1 and " " not in t,
    2: lambda t: bool(re.fullmatch(r"[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}", t)) and all(map(_small, re.findall("[0-9]+", t))),
    3: lambda t: bool(re.fullmatch(r"[0-9 .-]+", t)) and 12 <= len(_digits(t)) <= 19 and luhn(_digits(t)),
    4: lambda t: bool(re.fullmatch(r"[+0-9(][0-9 ().+-]*[0-9]", t)) and 7 <= len(_digits(t)) <= 15,
}


def fits(text: str) -> bool:
    """Whether a text keeps to the characters and digits of some kind."""
    return any(fit(text) for fit in _FIT.values())


def _added(graph: Graph, p: np.ndarray, texts: list[str], base: dict[int, list]) -> dict[int, list[tuple[int, int, str]]]:
    best = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
    near = {b for a, b in graph.chain}
    out: dict[int, list] = {}
    i = 0
    while i < len(best):
        j = i + 1
        while j < len(best) and best[i] and best[j] == best[i] and j in near and graph.spans[j][0] == graph.spans[i][0]:
            j += 1
        if best[i]:
            row, s, e = graph.spans[i][0], graph.spans[i][1], graph.spans[j - 1][2]
            text = texts[row][s:e]
            s, e = s + len(text) - len(text.lstrip(".,;:<>\"'")), e - len(text) + len(text.rstrip(".,;:<>\"'"))
            if s < e and _FIT[int(best[i])](texts[row][s:e]) and not any(a < e and s < b for a, b, _ in base.get(row, ())):
                out.setdefault(row, []).append((s, e, list(KINDS)[int(best[i]) - 1]))
        i = j
    return out


def find(texts: list[str], model: Model | None) -> tuple[dict[int, list], dict[int, list]]:
    """Base and added spans by the text's place in ``texts``."""
    base = {i: x for i, t in enumerate(texts) if (x := base_spans(t))}
    if model is None:
        return base, {}
    graph, known = Graph(), []
    for i, t in enumerate(texts):
        before = len(graph.spans)
        graph.add(i, t)
        mine = base.get(i, ())
        known += [next((KINDS[k] + 1 for a, b, k in mine if a < e and s < b), 0) for _, s, e in graph.spans[before:]]
    return base, _added(graph, model.marginals(graph, np.array(known, np.int64)), texts, base) if graph.spans else {}


def _within(graphs: DataFrame) -> list:
    """The rows of the smallest graphs, up to SAMPLE_TOKENS nodes in all, by key."""
    small = graphs.select("key", "turn", "n").orderBy("n", "key", "turn").limit(3 * SAMPLE).collect()
    total, kept = 0, []
    for r in small:
        total += r["n"]
        if total > SAMPLE_TOKENS:
            break
        kept.append(r)
    if not kept:
        return []
    last = kept[-1]
    order = F.struct("n", "key", "turn") <= F.struct(F.lit(last["n"]).alias("n"), F.lit(last["key"]).alias("key"), F.lit(last["turn"]).alias("turn"))
    return sorted(graphs.where(order).collect(), key=lambda r: (r["key"], r["turn"]))


def train(docs: DataFrame) -> Model | None:
    """A model from the sampled texts of ``docs`` (text), or None where there is nothing to learn from."""
    texts = docs.select(text_or_empty().alias("text")).where(F.col("text").rlike("[0-9@]")).select("text", F.md5(F.col("text").cast("binary")).alias("key"))
    chosen = [r["key"] for r in texts.select("key").distinct().orderBy("key").limit(SAMPLE).collect()]
    if not chosen:
        return None
    sample = texts.where(F.col("key") <= chosen[-1]).groupBy("key").agg(F.first("text").alias("text"))

    def graphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, whole in zip(batch["key"], batch["text"], strict=True):
                for turn, (text, spans, silent) in enumerate(lessons(whole)):
                    g = Graph()
                    g.add(0, text)
                    y = g.labels(text, spans, silent)
                    yield pd.DataFrame({"key": [key], "turn": [turn], "f": [np.array(g.features, np.int32).tobytes()], "y": [bytes(y)], "c": [np.array(g.chain, np.int32).tobytes()], "s": [np.array(g.skip, np.int32).tobytes()]})

    parts: list[list[np.ndarray]] = [[], [], [], []]
    n = 0
    listed = sample.select("key", "text").mapInPandas(graphs, "key string, turn int, f binary, y binary, c binary, s binary").withColumn("n", F.octet_length("y").cast("long"))
    # The bound holds before anything is collected: texts with most nodes are left out first, of equal ones the later keys.
    for r in _within(listed.where("n > 0")):
        y = np.frombuffer(r["y"], np.uint8)
        parts[0].append(np.frombuffer(r["f"], np.int32).reshape(-1, FEATURES))
        parts[1].append(y)
        parts[2].append(np.frombuffer(r["c"], np.int32).reshape(-1, 2) + n)
        parts[3].append(np.frombuffer(r["s"], np.int32).reshape(-1, 2) + n)
        n += len(y)
    if not n:
        return None
    model = Model()
    f, y, c, s = (np.concatenate(x) for x in parts)
    model.fit(f.astype(np.int64), y.astype(np.int64), c.astype(np.int64), s.astype(np.int64))
    return model


DIGEST = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long"


def digest(spark, model: Model | None) -> Column:
    """The digest columns of ``text`` as a struct."""
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = list(texts)
            base, more = find(texts, held.value)
            rows = []
            for i in range(len(texts)):
                mine = base.get(i, [])
                text = spans_digest(mine, KINDS)
                rows.append((*(sum(x[2] == k for x in mine) for k in KINDS), hashlib.sha256(text.encode()).hexdigest(), spans_digest(mine + more.get(i, []), KINDS), len(mine) + len(more.get(i, [])), len(more.get(i, []))))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added"])

    return F.pandas_udf(run, DIGEST)(text_or_empty())


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the digest columns of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", digest(docs.sparkSession, train(docs)).alias("_r")).select("doc_id", "_r.*")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Contract of op5 over all of ``documents``; the number of all spans and of those that the field added follow."""
    return find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
