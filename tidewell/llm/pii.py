"""Personal data: spans by fixed patterns, and further ones by a character-level bidirectional LSTM with a CRF.

The patterns come first and stay. The model reads overlapping windows; every span that it may add has a digit, an at sign in some form or
eight hexadecimal groups, so it is found from windows with one and, where its labels go on at a window's edge, their neighbours. Spans that
end at a window's edge are left to the neighbour that sees them whole; longer ones come from the windows' label paths joined, each
window giving the middle that it sees best. The spans of a text are then reconciled: joined ones and the best score first, none that
overlaps a better one or a pattern's match, each with the digits that its kind needs.

The model is trained from labelled spans before the job and sent to the tasks (a few hundred kB). Null and empty texts have no
spans. Rows are judged by themselves: repeated rows give repeated results, nothing is shuffled, other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Taken, decoded, documents, slices
from tidewell.llm.tagger import KINDS, WINDOW, codes, trained

STEP = WINDOW // 2
LONGEST = STEP  # some window holds such a span whole; longer ones are joined
LEAST_SCORE = 0.0
#: The patterns of the contract (fixed values). An ip's first digits start a run of digits; each other start gives the same end.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: What each span that sensible() accepts holds.
SIGN = re.compile(r"[0-9@]|\(at\)|\[at\]|\sat\s+\S+\s+dot\s|[0-9a-f](?=[0-9a-f]{0,3}(?:\s*[.:]\s*[0-9a-f]{1,4}){7})", re.I)
AT = re.compile(r"@|\(at\)|\[at\]|\sat\s+\S+\s+dot\s", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """EMAIL's matches. All of a local part leads to one at sign, so only its first character needs a try."""
    at, since = text.find("@"), 0
    while at >= 0:
        first = at
        while first > since and text[first - 1] in LOCAL_CHARS:
            first -= 1
        if m := EMAIL.match(text, first):
            yield m.span()
            since = m.end()
        else:
            since = at + 1
        at = text.find("@", since)


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base's spans, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-6:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def sensible(kind: int, text: str) -> bool:
    """Whether a span of the model has what its kind needs."""
    digits = NOT_DIGIT.sub("", text)
    if kind == 0:
        return bool(AT.search(text)) and sum(c.isalpha() for c in text) >= 4
    if kind == 1:
        parts = re.split(r"\s*[.:]\s*", text)
        return (len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)) or (len(parts) == 8 and all(re.fullmatch("[0-9A-Fa-f]{1,4}", p) for p in parts))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(digits) >= 0.6 * len(text) and not re.fullmatch("[0-9]+", text) and bool(re.fullmatch(r"[\x20()./0-9+-]+", text))


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a sign, on a fixed grid of STEP."""
    out: set[int] = set()
    for m in SIGN.finditer(text):
        at = m.start() // STEP
        out.update((at * STEP, max(at - 1, 0) * STEP))
    return sorted(out)


def found(y: np.ndarray, margin: np.ndarray, start: int, n: int, joined: bool = False):
    """(start, kind, end, score) of a window's spans of LONGEST at most, of joined windows the longer ones, but those that the edges cut while the text goes on."""
    k = 0
    while k < len(y):
        if y[k] == 0:
            k += 1
            continue
        kind, e = (int(y[k]) - 1) // 2, k + 1
        while e < len(y) and y[e] == 2 + 2 * kind:
            e += 1
        if (k > 0 or start == 0) and (e < len(y) or start + e >= n) and start + e <= n and (e - k > LONGEST) == joined:
            yield start + k, kind, start + e, float(margin[k:e].mean())
        k = e


def joins(paths: dict[int, tuple[np.ndarray, np.ndarray]]):
    """(start, labels, margins) of each run of neighbouring windows; neighbours meet in the middle of what both see."""
    starts = sorted(paths)
    runs = np.split(np.array(starts), np.flatnonzero(np.diff(starts) != STEP) + 1) if starts else []
    for run in (r.tolist() for r in runs):
        cut = (WINDOW - STEP) // 2
        parts = [slice(cut if a > run[0] else 0, WINDOW - cut if a < run[-1] else WINDOW) for a in run]
        yield run[0], *(np.concatenate([paths[a][x][p] for a, p in zip(run, parts, strict=True)]) for x in (0, 1))


def paths_of(model, texts: list[str]) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """For each text, start -> (labels, margins) of its windows with a sign, and of the neighbours that their spans go on in."""
    out: list[dict] = [{} for _ in texts]
    where = [(k, a) for k, t in enumerate(texts) if SIGN.search(t) for a in windows(t)]
    while where:
        further = set()
        for at in range(0, len(where), 2048):
            part = where[at : at + 2048]
            x = np.zeros((len(part), WINDOW), np.int64)
            for row, (k, a) in enumerate(part):
                points = codes(np.frombuffer(texts[k][a : a + WINDOW].encode("utf-32-le"), np.uint32))
                x[row, : len(points)] = points
            y, margin = model.decode(x)
            some = y.any(1)
            for row, (k, a) in enumerate(part):
                out[k][a] = (y[row], margin[row]) if some[row] else NOTHING
                if some[row] and y[row, 0] and a:
                    further.add((k, a - STEP))
                if some[row] and y[row, -1] and a + WINDOW < len(texts[k]):
                    further.add((k, a + STEP))
        where = sorted((k, a) for k, a in further if a not in out[k])
    return out


NOTHING = (np.zeros(WINDOW, np.int64), np.zeros(WINDOW))


def more(model, texts: list[str], base: list[list]) -> list[list[tuple[int, int, int]]]:
    """The spans that the model adds to each text."""
    out: list[list] = [[] for _ in texts]
    for k, paths in enumerate(paths_of(model, texts)):
        n = len(texts[k])
        own = [s for a, (y, margin) in paths.items() if y is not NOTHING[0] for s in found(y, margin, a, n)]
        own += [s for a, y, margin in joins(paths if any(y is not NOTHING[0] for y, _ in paths.values()) else {}) for s in found(y[: n - a], margin[: n - a], a, n, joined=True)]
        taken = Taken((a, b) for a, _, b in base[k])
        best: dict = {}
        for a, kind, b, score in own:
            best[a, kind, b] = max(score, best.get((a, kind, b), -1e9))
        for (a, kind, b), score in sorted(best.items(), key=lambda s: (s[0][2] - s[0][0] <= LONGEST, -s[1], s[0])):
            if score >= LEAST_SCORE and sensible(kind, texts[k][a:b]) and not taken.meets(a, b):
                taken.add(a, b)
                out[k].append((a, kind, b))
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string, redacted string"


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """A row for each row of df: doc_id, the base's counts, base and spans (kind:start:end in code points), and, with redact, the text with [KIND] for each span."""
    model = df.sparkSession.sparkContext.broadcast(trained())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in slices(batch, 1):
                rows = reports(model.value, [decoded(t) for t in texts], redact)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(rows)], ["doc_id", *NAMES])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {FOUND}")


NAMES = [x.split()[0] for x in FOUND.split(", ")]


def columns(rows: list[tuple]) -> list:
    import pyarrow as pa

    return [pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]


def reports(model, texts: list[str], redact: bool) -> list[tuple]:
    """The fields of FOUND for each text."""
    base = [patterns(t) if SIGN.search(t) else [] for t in texts]
    out = []
    for text, own, new in zip(texts, base, more(model, texts, base), strict=True):
        clean = None
        if redact:
            clean, since = [], 0
            for a, k, b in sorted(own + new):
                if b > since:
                    clean += [text[since : max(a, since)], f"[{KINDS[k].upper()}]"]
                    since = b
            clean = "".join([*clean, text[since:]])
        out.append((*(sum(k == kind for _, k, _ in own) for kind in range(4)), written(own), written(own + new), clean))
    return out


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with [KIND] in place of personal data in its texts; null texts stay null. All other columns stay, but chars_col follows the text."""
    model = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, raw in slices(batch, at):
                clean = [None if t is None else r[-1] for t, r in zip(raw, reports(model.value, [decoded(t) for t in raw], True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(clean, c.type) if k == at else c for k, c in enumerate(part.columns)], part.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(docs.columns)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans"))

