"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds, redaction.

Base patterns are exact and always kept. Wider generators propose further, overlapping candidates (spelled-out
addresses, other separators, numbers without a plus sign, IPv6 addresses, long keys of letters and digits). No table
says what personal data are, so trees learn from base spans of a bounded sample, from rewritten copies of them (the
same address spelled out, the same number with other separators, an address in the longer form) and from what fails
the base checks or is a near miss. Isotonic regression on held-out candidates turns their scores into probabilities,
kind by kind, and spans whose probability reaches `precision` are added. They never displace or overlap a base span.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from motionlake.llm.boosting import Boosted
from motionlake.llm.chunks import blocks
from motionlake.llm.common import bounded_sample, in_arrow
from motionlake.llm.quality import isotonic

#: Kinds with base patterns, and all kinds; spans that start together stand in this order.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Wider generators; what they find is only a candidate.
_WIDER = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:@| ?[\[(] ?(?:at|AT) ?[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(] ?(?:dot|DOT) ?[\])] ?)[A-Za-z0-9-]{2,}+)+"),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]++(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z.])[0-9]{4}(?:[ ._/-]?[0-9]{4}){2}[ ._/-]?[0-9]{1,7}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{20,}+"),
}
_HINTS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("tel", "phone", "call", "mobile", "fax"),
    "secret": ("token", "secret", "password", "passwd", "api", "key", "auth", "bearer", "credential"),
}
#: Words that stand before keys, and the pattern of what does; rewritten copies of each datum.
_SECRETS = ("token", "secret", "password", "passwd", "api_key", "access key", "private key", "auth", "bearer", "credential")
COPIES = 3
_KEY = re.compile(r"(?:token|secret|password|passwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credential)s?[\"']?\s{0,2}[:=]?\s{0,2}[\"']?$")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def is_ipv6(run: str) -> bool:
    """Whether a run of hexadecimal digits and colons is an address: eight groups, or fewer around one `::`."""
    if run.count(":") < 2 or len(run) > 39:
        return False
    groups = run.split(":")
    if any(len(g) > 4 for g in groups) or ":::" in run or run.count("::") > 1:
        return False
    if "::" not in run:
        return len(groups) == 8 and all(groups)
    return 0 < sum(map(bool, groups)) < 8 and (groups[0] != "" or groups[1] == "") and (groups[-1] != "" or groups[-2] == "")


def is_mixed(run: str) -> bool:
    """Whether a run holds a letter and a digit."""
    return any(c.isalpha() for c in run) and any(c.isdigit() for c in run)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @ so that long runs cost no more than their length."""
    out, last = [], 0
    if "@" not in text:
        return out
    for m in _DOMAIN.finditer(text):
        at, width = m.start(), 64
        while True:  # the run of local characters before the @, back to the end of the last match
            lo = max(last, at - width)
            part = text[lo:at]
            start = lo + len(part.rstrip(_LOCAL))
            if start > lo or lo == last:
                break
            width *= 4
        if start < at:
            out.append((start, m.end()))
            last = m.end()
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Spans that match and pass, and those that match but fail their check, as (start, end, kind)."""
    good = [(a, b, "email") for a, b in emails(text)]
    bad = []
    for m in _IP.finditer(text):
        passes = all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m[0].split("."))
        (good if passes else bad).append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        (good if 12 <= len(digits) <= 19 and luhn(digits) else bad).append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (good if 9 <= len(_only_digits(m[0])) <= 15 else bad).append((*m.span(), "phone"))
    return good, bad


def wider_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for kind, pattern in _WIDER.items():
        if kind == "email" and "@" not in text and "(" not in text and "[" not in text:
            continue
        if kind == "ip" and text.count(":") < 2:
            continue
        fits = {"ip": is_ipv6, "secret": is_mixed}.get(kind)
        out += [(*m.span(), kind) for m in pattern.finditer(text) if fits is None or fits(m[0])]
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span and its context."""
    span = text[start:end]
    digits = _only_digits(span)
    before = text[max(0, start - 30) : start]
    left, right = before[-1:], text[end : end + 1]
    groups = [len(x) for x in re.findall(r"[0-9]+", span)][:20]
    low, hint = before.lower(), span.lower()
    return [
        *(float(kind == k) for k in ALL_KINDS),
        len(span),
        len(digits),
        sum(c.isalpha() for c in span) / len(span),
        len(groups),
        float(groups[0] if groups else 0),
        float(max(groups, default=0)),
        float(kind in ("card", "phone") and len(set(groups)) == 1),
        float(kind == "card" and luhn(digits)),
        float(kind == "ip" and max((int(x[-6:]) for x in re.findall(r"[0-9]+", span)), default=0) <= 255),
        float(span.count(".")),
        float(span.count(":")),
        float(sum(span.count(c) for c in " -_/")),
        float(span[0] == "+"),
        float("(" in span and ")" in span),
        float("@" in span),
        float(bool(re.search(r"[\[(] ?at ?[\])]", hint))),
        float(bool(re.search(r"(?:\.|dot ?[\])] ?)[a-z]{2,6}$", hint))),
        float(left.isalnum() or left in "=_/"),
        float(right.isalnum() or right in "=_/"),
        float(any(w in low for w in _HINTS[kind])),
        float(bool(re.search(r"(?:token|key|secret|password|id|no|isbn)\W{0,4}$", low))),
        float(bool(_KEY.search(low))),
        len(set(span)) / len(span),
        sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False)) / len(span),
        float(max((len(x) for x in span.split(":")), default=0)),
    ]


def _rewritten(span: str, kind: str, rng: np.random.Generator) -> tuple[str, bool] | None:
    """The same datum in another form (true), or a near miss of it (false)."""
    if kind == "email":
        local, domain = span.split("@", 1)
        how = rng.integers(3)
        if how == 2:
            return f"{local} (at) {domain.split('.')[0]}", False
        return (f"{local} [at] {domain.replace('.', ' [dot] ')}" if how else f"{local} (at) {domain}"), True
    if kind == "secret":
        if rng.integers(2):
            words = "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in rng.integers(26, size=6))
            return f"{words}-{words}-{words}-{rng.integers(100)}", False
        return "".join("0123456789abcdefghijklmnopqrstuvwxyzABCDEF"[i] for i in rng.integers(42, size=int(20 * 100 ** rng.random()))), True
    digits = _only_digits(span)
    if kind == "ip":
        how = rng.integers(6)
        if how == 0:  # times, one after the other, look alike
            return ":".join(f"{i:02d}" for i in rng.integers(60, size=8)), False
        if how == 1:  # and so do names of code that happen to be hexadecimal
            return "::".join("".join("abcdef"[i] for i in rng.integers(6, size=int(rng.integers(2, 5)))) for _ in range(2)), False
        groups = [f"{i:x}" for i in rng.integers(1, 65536, size=8)]
        if rng.integers(2):  # link-local, documentation and private prefixes
            groups[0] = ("fe80", "2001", "fd00")[rng.integers(3)]
        if how > 3:
            cut = int(rng.integers(1, 4))
            return ":".join(groups[:cut]) + "::" + ":".join(groups[cut : cut + int(rng.integers(1, 4))]), True
        return ":".join(groups), True
    if kind == "card":
        if rng.integers(2):  # a wrong check digit
            digits = digits[:-1] + str((int(digits[-1]) + 1 + rng.integers(9)) % 10)
            return "".join(digits), luhn(digits)
        return "._/"[rng.integers(3)].join(digits[i : i + 4] for i in range(0, len(digits), 4)), True
    if kind == "phone" and len(digits) >= 10:
        number = digits[-10:]
        how = rng.integers(3)
        if how == 2:
            return number[:3] + number[3:6] + "." + number[6:], False
        return (f"({number[:3]}) {number[3:6]}-{number[6:]}" if how else f"{number[:3]}-{number[3:6]}-{number[6:]}"), True
    return None


def _union(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order and apart."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


class Detector:
    """trees: score of a candidate; calibration: for each kind scores and the probabilities that they stand for;
    precision: the probability from which a candidate is taken."""

    def __init__(self, trees: Boosted | None, calibration: dict[str, tuple[np.ndarray, np.ndarray]], precision: float):
        self.trees, self.calibration, self.precision = trees, calibration, precision

    def probability(self, text: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
        scores = self.trees.probability(np.array([features(text, *s) for s in spans]))
        out = np.zeros(len(spans))
        for kind, steps in self.calibration.items():
            own = np.array([s[2] == kind for s in spans])
            out[own] = np.interp(scores[own], *steps)
        return out

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and all spans, by start and kind. Time grows with the text's length, times the logarithm of the
        number of its spans."""
        text = text or ""
        order = lambda s: (s[0], ALL_KINDS.index(s[2]), s[1])
        base, _ = base_spans(text)
        base.sort(key=order)
        if self.trees is None:
            return base, base
        starts, ends = _union(base)
        free = lambda s: (i := bisect_right(ends, s[0])) == len(ends) or starts[i] >= s[1]
        more = [s for s in wider_spans(text) if free(s)]
        if not more:
            return base, base
        p = self.probability(text, more)
        picked: list[tuple[int, int, str]] = []
        for i in np.lexsort((np.arange(len(more)), -p)).tolist():  # overlapping candidates: the likeliest stays
            if p[i] < self.precision:
                break
            s = more[i]
            at = bisect_left(picked, s)
            if (at == 0 or picked[at - 1][1] <= s[0]) and (at == len(picked) or picked[at][0] >= s[1]):
                picked.insert(at, s)
        return base, sorted(base + picked, key=order)


def cases(text: str) -> list[tuple[str, int, int, str, bool]]:
    """What trees learn from a text: (text, start, end, kind, whether it is personal data)."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    good, bad = base_spans(text)
    keys = [s for s in wider_spans(text) if s[2] == "secret"]
    good_keys = [s for s in keys if _KEY.search(text[max(0, s[0] - 30) : s[0]].lower())]
    out = [(text, *s, True) for s in good + good_keys] + [(text, *s, False) for s in bad if s[1] - s[0] > 5]
    out += [(text, *s, False) for s in keys if s not in good_keys]
    for a, b, kind in good + good_keys:
        for _ in range(COPIES):
            if other := _rewritten(text[a:b], kind, rng):
                around = text[max(0, a - 40) : a]
                if kind == "secret" and other[1] and rng.integers(2):  # another word before it
                    around = _KEY.sub("", around) + _SECRETS[rng.integers(len(_SECRETS))] + (": ", " = ", "=", " ", '="')[rng.integers(5)]
                out.append((around + other[0] + text[b : b + 20], len(around), len(around) + len(other[0]), kind, other[1]))
    return out


def train(docs: DataFrame, sample_rows: int = 4000, precision: float = 0.95, most: int = 40_000, seed: int = 11) -> Detector:
    """Fit on candidates in at most `sample_rows` documents, chosen by a hash of the id; `most` candidates at most.

    Seven tenths of the candidates fit the trees, the others calibrate them. A kind without held-out candidates adds no
    spans. Without candidates of both outcomes the detector finds base spans only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                rows: list[list] = [[], [], []]
                for text in part.column("text").to_pylist():
                    for case in cases(text) if text else ():
                        rows[0].append(ALL_KINDS.index(case[3]))
                        rows[1].append(features(*case[:4]))
                        rows[2].append(case[4])
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.list_(pa.float64())), pa.array(rows[2], pa.bool_())], names=["kind", "x", "y"])

    found = in_arrow(bounded_sample(docs.select("doc_id", "text"), "doc_id", sample_rows), run, "kind int, x array<double>, y boolean").limit(most).collect()
    y = np.array([r.y for r in found], float)
    if not 0 < y.sum() < len(y):
        return Detector(None, {}, precision)
    x, kind = np.array([r.x for r in found]), np.array([r.kind for r in found])
    apart = np.random.default_rng(seed).random(len(y)) < 0.3
    trees = Boosted().fit(x[~apart], y[~apart])
    p = trees.probability(x[apart])
    calibration = {}
    for k, name in enumerate(ALL_KINDS):
        own = kind[apart] == k
        if own.any():
            order = np.argsort(p[own], kind="stable")
            calibration[name] = isotonic(p[own][order], y[apart][own][order], np.ones(len(order)))
    return Detector(trees, calibration, precision)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def report(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, base spans counted by kind, base_sha256, spans and n_spans (all of them) of each row.

    A null text counts as empty. Repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                found = [detector.spans(x) for x in part.column("text").to_pylist()]
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                base = [hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([_joined(e) for _, e in found], pa.string()), pa.array([len(e) for _, e in found], pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """All columns, each span of `text` replaced by its kind in brackets; of overlapping spans the union goes.

    n_chars, where there is one, follows the new text. Null texts stay null.
    """
    keep = docs.columns

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, b, kind in detector.spans(text)[1]:
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                texts = [clean(x) for x in part.column("text").to_pylist()]
                columns = {c: part.column(c) for c in keep} | {"text": pa.array(texts, part.schema.field("text").type)}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if x is None else len(x) for x in texts], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=keep)

    return in_arrow(docs, run, docs.schema)
