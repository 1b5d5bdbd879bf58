"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

Lafferty, McCallum, Pereira, "Conditional Random Fields", ICML 2001. The patterns are exact and their spans always stay. The field
reads the words around every trigger (a word with a digit or an at-sign, or one that spells it) and labels them
with B- and I- of the four kinds or none. What it labels and no pattern has is added if it holds up as its kind once its
separators are undone: an address with its dots and at-sign spelled out, a telephone number without its plus, an address of
four parts with brackets, a card number that runs into another number.

Training table: a small labelled list below, and at most twice SAMPLE windows of the documents themselves, labelled
by the patterns, half of them without a span, of the ids with the smallest hashes. Every labelled span is also shown in rewritten forms, so the field learns shapes and
order instead of the patterns. Features are those of a word's shape (letters, digits and marks), the words before and
behind it, and a few cue words; weights are fitted by the gradient of the exact likelihood (forward and backward sums), labels
are found by Viterbi, both over padded batches of windows.

Cases: a null text is an empty one and has no spans; rows that are equal get equal results; a null id is kept; words of over
WORD bytes are alike to the field (the patterns read them all the same); no rows give no rows; without a span in the
sample the labelled list alone trains the field.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import id_and_bytes, map_rows, materialize, table

KINDS = ("email", "ip", "card", "phone")
#: B- and I- of each kind behind none.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Documents that the sample is taken from, and its windows with a span and without, at most.
SAMPLE_DOCS, SAMPLE = 4_000, 500
#: Words before and behind a trigger that a window holds, words of a window, and bytes of a word that has features.
REACH, WINDOW, WORD = 6, 40, 64
#: Bytes behind a word for an at-sign in which a dot is looked for.
AHEAD = 120
#: Words whose features a task keeps at most before it starts anew, and windows that are decoded at once.
KNOWN_WORDS, BATCH = 200_000, 2_048

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# ---- fixed values: what stands for an at-sign and a dot, and cue words --------------------------------------------------
AT_WORDS = ("at", "[at]", "(at)", "<at>", "{at}")
DOT_WORDS = ("dot", "[dot]", "(dot)", "<dot>", "{dot}")
CUES = ("tel", "phone", "call", "fax", "mobile", "mail", "email", "e-mail", "ip", "host", "server", "card", "visa", "number", "account", "order", "id", "version", "year")

#: Labelled lines: {kind:text} marks a span.
LABELLED = (
    "please write to {email:anna.lee at example dot com} before noon",
    "reach me under {email:j_smith [at] mail.example [dot] org} or by post",
    "contact {email:info(at)example.net} for the list",
    "my mail is {email:otto9 at post dot example dot de} thanks",
    "send it to {email:kim@example.com} and wait",
    "call {phone:(212) 555-0147} after six",
    "tel {phone:212-555-0199} or {phone:+44 20 7946 0958} at work",
    "phone {phone:0171 555 0123} in the morning",
    "fax: {phone:1 415 555 0134}.",
    "the host {ip:10[.]0[.]0[.]12} did not answer",
    "from {ip:192.168.4.7} to {ip:172 . 16 . 0 . 9} and back",
    "blocked {ip:203 dot 0 dot 113 dot 9} at the gate",
    "card {card:4111 1111 1111 1111} was charged",
    "paid with {card:5500.0000.0000.0004} on friday",
    "number {card:4012888888881881} expires soon",
    "we meet at the old dot of paint at noon",
    "two cards {card:4012888888881881} {card:5500000000000004} in a row",
    "{card:4111111111111111} {card:4012888888881881} both stolen",
    "from {phone:+1 (212) 555-0147} {card:4111111111111111} and gone",
    "by {phone:+1 (415) 555-0134} {ip:198.51.100.7} at night",
    "order 20231145 has 12 items at 3.50 each",
    "version 4.1.2.17b of the build 99120 at 10:45",
    "the year 2024 - 2025 report has 1,204 pages",
    "key 24be64439e3e49cf46b2d7c90f3602a3 is void",
    "section 3.2.1 and 3.2.2 of part 10",
    "scores were 21-19, 18-21 and 22-20 at last",
    "isbn 978-3-16-148410-0 is at the library",
    "on 2024-05-17 at 12:30:45 the job ended",
    "user @handle said hello at 5 pm",
)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = at = -1
    while (at := text.find("@", at + 1)) >= 0:
        begin = max(end, text.rfind("@", 0, at) + 1, 0)
        local = at - begin - len(text[begin:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if local else None
        if found:
            end = found.end()
            yield at - local, end


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts, at = chain[0].split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in four):
                yield at, at + size
            at += size + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind by the fixed patterns, leftmost and without overlap; a match that fails its test is dropped."""
    digits = bool(re.search("[0-9]", text))
    return {
        "email": list(_emails(text)), "ip": list(_ips(text)) if digits else [],
        "card": list(_cards(text)) if digits else [], "phone": list(_phones(text)) if digits and "+" in text else [],
    }


# ---- features ---------------------------------------------------------------------------------------------------------

_SHAPE = bytes(100 if 48 <= c <= 57 else 120 if 97 <= c <= 122 or c >= 128 else 88 if 65 <= c <= 90 else c for c in range(256))


def features(word: bytes) -> list[str]:
    """Names of the features of a word."""
    if len(word) > WORD:
        return ["long"]
    shape = word.translate(_SHAPE)
    runs = re.sub(rb"(.)\1+", rb"\1", shape)
    digits = shape.count(b"d")
    core = word.decode("utf-8", "replace").strip(".,;:!?\"'").lower()
    out = [f"shape {shape.decode('ascii')}" if len(shape) <= 24 else "wide", f"runs {runs.decode('ascii')[:24]}"]
    out.append(f"digits {digits if digits < 5 else min(20, digits) // 4 * 4}")
    out += [f"holds {c}" for c in "@.-()[]+:/_#=" if c.encode() in word]
    out.append(f"first {chr(shape[0])}")
    out.append(f"last {chr(shape[-1])}")
    if digits and not shape.strip(b"d.,;:()-+"):
        out.append("number")
        out.append(f"groups {min(6, len(re.findall(rb'd+', shape)))}")
    if 16 <= digits <= 19:
        out.append("card" if luhn(re.sub(rb"[^0-9]", b"", word).decode("ascii")) else "no card")
    parts = core.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append("four parts" if all(int(p) < 256 for p in parts) else "large parts")
    if len(parts) == 1 and digits and core.isascii() and core.isdigit():
        out.append("byte" if len(core) < 4 and int(core) < 256 else "more")
    if core in AT_WORDS or word.lower() in {w.encode() for w in AT_WORDS}:
        out.append("at")
    if core in DOT_WORDS or word.lower() in {w.encode() for w in DOT_WORDS}:
        out.append("dot")
    if core in CUES:
        out.append(f"cue {core}")
    return out


_OPEN, _CLOSE = rb"[\[({<]", rb"[\])}>]"
_TRIGGER = re.compile(rb"[0-9@]|(?<!\S)" + _OPEN + rb"?[aA][tT]" + _CLOSE + rb"?(?!\S)|" + _OPEN + rb"[aA][tT]" + _CLOSE)
_DOT = re.compile(rb"(?<!\S)" + _OPEN + rb"?[dD][oO][tT]" + _CLOSE + rb"?(?!\S)|[A-Za-z0-9]\.[A-Za-z0-9]|\[dot\]|\(dot\)")


def _triggers(text: bytes) -> Iterator[int]:
    """Where digits and at-signs stand, and words for an at-sign with a dot or a word for one in the AHEAD bytes behind."""
    for m in _TRIGGER.finditer(text):
        if m[0][0] in b"0123456789@" or _DOT.search(text, m.end(), m.end() + AHEAD):
            yield m.start()


def windows(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first word, words) of the runs of words around triggers, cut after WINDOW words with an overlap of REACH."""
    places = list(_triggers(text))
    if not places:
        return
    words, starts = text.split(), [m.start() for m in re.finditer(rb"\S+", text)]
    begin = end = -1
    for k in np.unique(np.searchsorted(starts, places, side="right") - 1).tolist():
        if begin >= 0 and k - REACH <= end:
            end = k + REACH + 1
            continue
        if begin >= 0:
            yield from _cut(words, begin, end)
        begin, end = max(0, k - REACH), k + REACH + 1
    yield from _cut(words, begin, min(end, len(words)))


def _cut(words: list[bytes], begin: int, end: int) -> Iterator[tuple[int, list[bytes]]]:
    while end - begin > WINDOW:
        yield begin, words[begin : begin + WINDOW]
        begin += WINDOW - REACH
    yield begin, words[begin:end]


# ---- the field --------------------------------------------------------------------------------------------------------


class Field:
    """A linear-chain conditional random field; travels to the tasks."""

    def __init__(self, table: list[tuple[list[bytes], list[int]]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-4):
        """table: (words, labels) of every window. Weights by Adam over the whole table, from zero, so the result is fixed."""
        self.number: dict[str, int] = {}
        for words, _ in table:
            for w in words:
                for f in features(w):
                    self.number.setdefault(f, len(self.number))
        self._known: dict[bytes, int] = {}
        self._rows: list[list[int]] = []
        n, k = len(self.number), len(LABELS)
        self.weights = {"word": np.zeros((3, n + 1, k)), "next": np.zeros((k, k)), "first": np.zeros(k)}
        self._forbid()
        if table:
            self._fit(table, rounds, rate, decay)
        self.forget()

    def _forbid(self) -> None:
        """I- of a kind follows its B- or I- only."""
        self.barred, self.barred_first = np.zeros((len(LABELS),) * 2), np.zeros(len(LABELS))
        for b, name in enumerate(LABELS):
            if name[0] == "I":
                self.barred_first[b] = -1e4
                self.barred[[a for a, x in enumerate(LABELS) if x[2:] != name[2:] or x == "O"], b] = -1e4

    def forget(self) -> None:
        self._known, self._rows, self._scores = {}, [], np.zeros((3, 0, len(LABELS)))

    def types(self, words: Iterable[bytes]) -> list[int]:
        """Numbers of words by their features; a new word gets the next."""
        out = []
        for w in words:
            t = self._known.get(w)
            if t is None:
                t = self._known[w] = len(self._rows)
                self._rows.append([self.number[f] for f in features(w) if f in self.number])
            out.append(t)
        return out

    def _matrix(self) -> np.ndarray:
        out = np.zeros((len(self._rows), len(self.number) + 1))
        for t, row in enumerate(self._rows):
            out[t, row] = 1
        return out

    def _fit(self, table: list[tuple[list[bytes], list[int]]], rounds: int, rate: float, decay: float) -> None:
        seqs = [self.types(w) for w, _ in table]
        x, length = _padded(seqs)
        gold, _ = _padded([y for _, y in table])
        flags = self._matrix()
        inside = np.arange(x.shape[1]) < length[:, None]
        first, second = {k: np.zeros_like(v) for k, v in self.weights.items()}, {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, rounds + 1):
            unary = self._unary(x, inside, np.stack([flags @ w for w in self.weights["word"]]))
            node, edge, _ = _expected(unary, length, self.weights["next"] + self.barred, self.weights["first"] + self.barred_first)
            node[np.arange(len(x))[:, None], np.arange(x.shape[1]), gold] -= 1
            node *= inside[..., None]
            both = inside[:, 1:]
            np.subtract.at(edge, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            grads = {"next": edge, "first": node[:, 0].sum(0), "word": np.stack([flags.T @ g for g in self._spread(x, inside, node, len(flags))])}
            for name, g in grads.items():
                g = g / len(x) + decay * self.weights[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                self.weights[name] -= rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)

    @staticmethod
    def _unary(x: np.ndarray, inside: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """(windows, places, labels): what the word, the one before and the one behind say."""
        out = scores[0][x]
        out[:, 1:] += scores[1][x[:, :-1]]
        out[:, :-1] += scores[2][x[:, 1:]] * inside[:, 1:, None]
        return out

    @staticmethod
    def _spread(x: np.ndarray, inside: np.ndarray, node: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Sums of `node` by the number of the word, of the one before and of the one behind."""
        for at, of in ((x, node), (x[:, :-1], node[:, 1:]), (x[:, 1:], node[:, :-1] * inside[:, 1:, None])):
            out = np.zeros((n, node.shape[2]))
            np.add.at(out, at.ravel(), of.reshape(-1, node.shape[2]))
            yield out

    def label(self, found: list[list[bytes]]) -> list[np.ndarray]:
        """The best labels of every window, by Viterbi."""
        if len(self._known) > KNOWN_WORDS:
            self.forget()
        seqs = [self.types(w) for w in found]
        old = self._scores.shape[1]
        if len(self._rows) > old:
            new = np.zeros((3, len(self._rows) - old, len(LABELS)))
            for t, row in enumerate(self._rows[old:]):
                new[:, t] = self.weights["word"][:, row].sum(1)
            self._scores = np.concatenate([self._scores, new], axis=1)
        x, length = _padded(seqs)
        inside = np.arange(x.shape[1]) < length[:, None]
        unary = self._unary(x, inside, self._scores)
        best = viterbi(unary, length, self.weights["next"] + self.barred, self.weights["first"] + self.barred_first)
        return [b[:n] for b, n in zip(best, length.tolist(), strict=True)]


def _padded(seqs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(s) for s in seqs], np.int64)
    out = np.zeros((len(seqs), int(length.max(initial=1))), np.int64)
    for k, s in enumerate(seqs):
        out[k, : len(s)] = s
    return out, length


def _expected(unary: np.ndarray, length: np.ndarray, follow: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the labels at every place, the expected number of each pair of labels in a row, and the log of each sum.

    Sums are scaled at every place, so they neither overflow nor vanish.
    """
    n, size, k = unary.shape
    most = unary.max(2, keepdims=True)
    here, step = np.exp(unary - most), np.exp(follow)
    inside = np.arange(size) < length[:, None]
    ahead, scale = np.zeros((n, size, k)), np.ones((n, size))
    now = np.exp(first) * here[:, 0]
    for t in range(size):
        if t:
            now = (ahead[:, t - 1] @ step) * here[:, t]
        scale[:, t] = np.where(inside[:, t], now.sum(1), 1)
        ahead[:, t] = now / np.maximum(scale[:, t], 1e-300)[:, None]
    behind, edge = np.ones((n, size, k)), np.zeros((k, k))
    for t in range(size - 2, -1, -1):
        on = inside[:, t + 1]
        back = here[:, t + 1] * behind[:, t + 1] / scale[:, t + 1, None]
        behind[:, t] = np.where(on[:, None], back @ step.T, 1)
        edge += step * (ahead[on, t].T @ back[on])
    whole = (np.log(scale) + np.where(inside, most[..., 0], 0)).sum(1)
    return ahead * behind, edge, whole


def viterbi(unary: np.ndarray, length: np.ndarray, follow: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The labels of the highest sum for every row of a padded batch; of equal sums the first label."""
    n, size, k = unary.shape
    back = np.zeros((n, size, k), np.int8)
    score = first + unary[:, 0]
    for t in range(1, size):
        paths = score[:, :, None] + follow
        back[:, t] = paths.argmax(1)
        new = paths.max(1) + unary[:, t]
        score = np.where((t < length)[:, None], new, score)
    out = np.zeros((n, size), np.int8)
    rows, now = np.arange(n), score.argmax(1)
    for t in range(size - 1, -1, -1):
        now = np.where(t + 1 < length, back[rows, min(t + 1, size - 1), now], now) if t + 1 < size else now
        out[:, t] = now
    return out


# ---- training table ---------------------------------------------------------------------------------------------------


def parse_labelled(line: str) -> tuple[list[bytes], list[int]]:
    """Words and labels of a line of LABELLED."""
    words, labels = [], []
    for k, part in enumerate(re.split(r"\{(\w+):([^}]*)\}", line)):
        if k % 3 == 1:
            kind = part
            continue
        new = part.encode().split()
        if k % 3 == 0 and words and part and not part[0].isspace() and new:  # a mark that touches the span
            words[-1] += new.pop(0)
        words += new
        labels += [0] * len(new) if k % 3 == 0 else [1 + 2 * KINDS.index(kind) + (j > 0) for j in range(len(new))]
    return words, labels


def labelled_windows(text: bytes) -> Iterator[tuple[list[bytes], list[int]]]:
    """The windows of a text with the labels of the patterns' spans."""
    plain = text.decode("utf-8", "replace")
    starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", plain)]
    of = np.zeros(len(starts), np.int64)
    for kind, spans in base_spans(plain).items():
        for a, b in spans:
            low, high = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, b)
            of[low:high] = 2 + 2 * KINDS.index(kind)
            of[low] = 1 + 2 * KINDS.index(kind)
    for at, words in windows(text):
        labels = of[at : at + len(words)].tolist()
        if labels and labels[0] and labels[0] % 2 == 0:  # a window that begins inside a span
            labels[0] -= 1
        yield words, labels


def rewritten(words: list[bytes], labels: list[int], draw: random.Random) -> Iterator[tuple[list[bytes], list[int]]]:
    """The window, and again with its spans in another form."""
    yield words, labels
    if not any(labels):
        return
    out, to, k = [], [], 0
    while k < len(words):
        if not labels[k]:
            out.append(words[k])
            to.append(0)
            k += 1
            continue
        end = k + 1
        while end < len(words) and labels[end] == labels[k] + 1:
            end += 1
        kind = KINDS[(labels[k] - 1) // 2]
        span = b" ".join(words[k:end]).decode("utf-8", "replace")
        core = span.strip(".,;:!?\"'#$%&*")
        lead, tail = (span.split(core, 1) if core else (span, ""))
        new = f"{lead}{_other_form(kind, core, draw)}{tail}".encode().split()
        out += new
        to += [labels[k] + (j > 0) for j in range(len(new))]
        k = end
    yield out, to


def _other_form(kind: str, text: str, draw: random.Random) -> str:
    if kind == "email":
        at, dot = draw.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", " . "), (" at ", ".")])
        local, _, domain = text.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == "phone":
        bare = text.lstrip("+")
        groups = re.findall("[0-9]+", bare)
        return draw.choice([" ".join(groups[1:] or groups), "-".join(groups[1:] or groups), bare, ".".join(groups), bare.partition(" ")[2] or bare])
    if kind == "ip":
        return text.replace(".", draw.choice(["[.]", " . ", " dot ", "[dot]", "(.)"]))
    digits = re.sub("[^0-9]", "", text)
    between = draw.choice([" ", ".", "-", "", "/"])
    return between.join(digits[k : k + 4] for k in range(0, len(digits), 4))


def undone(kind: str, text: str) -> bool:
    """Whether a text holds up as its kind once its separators are undone."""
    if kind == "email":
        for words, mark in ((AT_WORDS, "@"), (DOT_WORDS, ".")):
            for w in words[1:]:
                text = re.sub(r"\s*" + re.escape(w) + r"\s*", mark, text, flags=re.IGNORECASE)
        text = re.sub(r"\s+at\s+", "@", text, flags=re.IGNORECASE) if "@" not in text else text
        text = re.sub(r"\s+dot\s+", ".", text, flags=re.IGNORECASE)
        text = re.sub(r"\s*([@.])\s*", r"\1", text)
        return list(_emails(text)) == [(0, len(text))]
    if kind == "ip":
        text = re.sub(r"\s*(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\bdot\b|\.)\s*", ".", text)
        return list(_ips(text)) == [(0, len(text))] and text.count(".") == 3
    digits = re.sub("[^0-9]", "", text)
    if re.search(r"[^0-9 ().+/-]", text):
        return False
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and len(re.findall("[0-9]+", text)) > 1


def training_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample: int = SAMPLE) -> DataFrame:
    """(words, labels) of at most `sample` windows with spans and as many without, by hash, of at most `sample_docs` ids."""
    ids = docs.where(F.col(text_col).rlike("[0-9@]") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)
    chosen = docs.join(F.broadcast(ids), F.col(id_col) == F.col("__id"), "left_semi")
    schema = T.StructType([T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("labels", T.ArrayType(T.IntegerType()))])

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        for _, text in texts:
            yield from labelled_windows(text)

    found = materialize(map_rows(id_and_bytes(chosen, id_col, text_col), schema, rows, size=1024), "windows")
    none, order = F.forall("labels", lambda y: y == 0), (F.xxhash64("words"), F.to_json(F.struct("labels")))
    return found.where(~none).orderBy(*order).limit(sample).union(found.where(none).orderBy(*order).limit(sample))


def train(table_rows: Iterable[tuple[list[bytes], list[int]]]) -> Field:
    """The field of a labelled table, of LABELLED, and of all their spans in other forms."""
    draw, rows = random.Random(7), []
    for words, labels in [*map(parse_labelled, LABELLED), *table_rows]:
        rows += list(rewritten(list(words), list(labels), draw))
    return Field([r for r in rows if r[0]])


def _added(plain: str, taken: list[tuple[int, int]], at: int, words: list[bytes], labels: np.ndarray, starts: list[int]) -> Iterator[tuple]:
    """(kind, start, end) of the labelled runs of a window that hold up and overlap none of `taken`."""
    k = 0
    while k < len(words):
        if not labels[k]:
            k += 1
            continue
        end = k + 1
        while end < len(words) and labels[end] == labels[k] + 1:
            end += 1
        kind = KINDS[(int(labels[k]) - 1) // 2]
        for a, b in [(k, end), *((x, x + 1) for x in range(k, end) if end - k > 1)]:  # the whole run, else its words
            begin, stop = starts[at + a], starts[at + b - 1] + len(words[b - 1].decode("utf-8", "replace"))
            core = plain[begin:stop].rstrip(".,;:!?\"'#$%&*])}>")
            stop = begin + len(core)
            core = core.lstrip("\"'#$%&*[{<" if kind == "phone" else "\"'#$%&*[({<")
            begin = stop - len(core)
            if core and undone(kind, core):
                if all(stop <= x or y <= begin for x, y in taken):
                    yield kind, begin, stop
                if b - a == end - k:
                    break
        k = end


def spans_of(texts: list[tuple], field: Field) -> Iterator[tuple]:
    """(id, base spans, added spans) of some texts (id, bytes); both map kinds to spans in code points."""
    held, found = [], []
    for i, text in texts:
        plain = text.decode("utf-8", "replace")
        own = list(windows(text))
        held.append((i, plain, base_spans(plain), len(own)))
        found += own
    labels: list[np.ndarray] = []
    order = sorted(range(len(found)), key=lambda k: len(found[k][1]))  # windows of like lengths together
    by: dict[int, np.ndarray] = {}
    for a in range(0, len(order), BATCH):
        part = order[a : a + BATCH]
        by.update(zip(part, field.label([found[k][1] for k in part]), strict=True))
    labels = [by[k] for k in range(len(found))]
    k = 0
    for i, plain, base, n in held:
        added: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
        starts = None
        taken = [s for spans in base.values() for s in spans]
        for (at, words), y in zip(found[k : k + n], labels[k : k + n], strict=True):
            if y.any():
                starts = starts or [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", plain)]
                for kind, begin, end in _added(plain, taken, at, words, y, starts):
                    added[kind].append((begin, end))
                    taken.append((begin, end))
        k += n
        yield i, base, added


def _listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None, chunk_bytes: int = 1 << 21) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base, spans) of every row.

    The counts are those of the patterns' spans, n_added that of the field's. base and spans list kind:start:end, by kind and
    then start, in code points, the end exclusive; spans holds both. Without `field` one is trained on `docs`.
    """
    spark = docs.sparkSession
    if field is None:
        field = train([([bytes(w) for w in r["words"]], list(r["labels"])) for r in training_table(docs, id_col, text_col).collect()])
    sent = spark.sparkContext.broadcast(field)
    counts = [T.StructField(f"n_{k}", T.LongType()) for k in (*KINDS, "added")]
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *counts, T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        machine = sent.value

        def flush(held: list[tuple]) -> Iterator[tuple]:
            for i, base, added in spans_of(held, machine):
                whole = {k: [*base[k], *added[k]] for k in KINDS}
                yield i, *(len(base[k]) for k in KINDS), sum(map(len, added.values())), _listed(base), _listed(whole)

        held, size = [], 0
        for row in texts:
            held.append(row)
            size += len(row[1])
            if size > chunk_bytes:
                yield from flush(held)
                held, size = [], 0
        yield from flush(held)

    return map_rows(id_and_bytes(docs, id_col, text_col), out, rows)


def mask(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with every span of `find_pii` replaced by its kind in brackets; ids must be unique."""

    def replaced(text: str, spans: str) -> str:
        out, at = [], 0
        for begin, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
            if begin >= at:
                out += [text[at:begin], f"<{kind}>"]
                at = end
        return "".join([*out, text[at:]])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text", T.StringType())])
    both = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(found.select("doc_id", "spans"), "doc_id")
    return map_rows(both, schema, lambda rows: ((i, replaced(t, s)) for i, t, s in rows), size=256)


def op12_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and a digest of the patterns' spans, and all spans."""
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")
