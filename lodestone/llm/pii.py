"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans. Around what may be personal data, a text is cut into tokens, and segments of up to
LENGTH tokens are scored as a whole for each kind: by their digits, separators, checksums, shape and the words before
them. Dynamic programming over bounded entities picks the best sequence of segments and kinds at once. Base spans
stand; entities that touch none are added.

The field is trained on a bounded sample of texts with digits or at signs: the base spans are its labels, and of each
some are rewritten in ways that people write such data and the patterns miss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
# Groups that no shorter match could help are possessive, so that a search takes time in proportion to the text.
AT = re.compile(r"(?<=[A-Za-z0-9._%+-])@(?=[A-Za-z0-9-])")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address is what stands before an at sign, back to the one before or to the last match, and a domain behind it."""
    done = 0
    for m in AT.finditer(text):
        at = m.start()
        if at <= done:
            continue
        if domain := DOMAIN.match(text, at + 1):
            a = at
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            yield a, domain.end()
            done = domain.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


# -- the field

LENGTH, LONGEST = 7, 120
#: Tokens kept before and after one that may be part of an entity.
AROUND = 2
TOKEN = re.compile(r"[^\s]+")
TRIGGER = re.compile(r"[0-9@]")
#: The word between name and host of a spelt-out address; what follows it, if it stands by itself.
SAYS_AT = re.compile(r"\[at\]|\(at\)|(?<=\s)at(?=\s)")
SAYS_DOT = re.compile(r"\s{1,8}\S{1,100}\s{1,8}(?:dot|\[dot\]|\(dot\))(?=\s)")
SPELT = re.compile(r"\S+\s+(?:at|\[at\]|\(at\))\s+\S+\s+(?:dot|\[dot\]|\(dot\))\s+\S+|\S+(?:\[at\]|\(at\))\S+")
EDGE = re.compile(r"^[^0-9A-Za-z+(]+|[^0-9A-Za-z)]+$")
CUES = {"email": 0, "mail": 0, "e-mail": 0, "contact": 0, "ip": 1, "address": 1, "host": 1, "server": 1, "card": 2, "visa": 2, "credit": 2, "pan": 2, "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3}
_AT = r"(?:@|\s@\s|\s?\[at\]\s?|\s?\(at\)\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\s+dot\s+)"
EMAIL_LIKE = re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
FOUR_LIKE = re.compile(r"([0-9]+)(?:\s?\[?\.\]?\s?)([0-9]+)(?:\s?\[?\.\]?\s?)([0-9]+)(?:\s?\[?\.\]?\s?)([0-9]+)")
CARD_LIKE = re.compile(r"[0-9]{4}[ ./_-]{1,2}[0-9]{4}[ ./_-]{1,2}[0-9]{4}[ ./_-]{1,2}[0-9]{1,7}|[0-9]{13,19}")
PHONE_LIKE = re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}")
FEATURES = ["bias", "email", "at", "four", "four_small", "card", "luhn", "card_no_luhn", "phone", "plus", "paren", "plain", "letters", "many_dots", "hex", "d0", "d1", "d5", "d7", "d9", "d12", "d13", "d20", "one", "two", "three", "long", *(f"cue{k}" for k in range(4)), "more_digits"]
_F = {f: k for k, f in enumerate(FEATURES)}
N = len(FEATURES)


def features(span: str, tokens: int, before: str, beside: str) -> list[int]:
    """What a segment shows as a whole. before: the two words before it; beside: the characters that touch it."""
    out = ["bias"]
    d = digits_of(span)
    if EMAIL_LIKE.fullmatch(span):
        out.append("email")
    if "@" in span:
        out.append("at")
    if m := FOUR_LIKE.fullmatch(span):
        out.append("four_small" if all(map(small, m.groups())) else "four")
    if CARD_LIKE.fullmatch(span):
        out += ["card"] if not 13 <= len(d) <= 19 else ["card", "luhn"] if luhn(d) else ["card", "card_no_luhn"]
    if PHONE_LIKE.fullmatch(span) and 9 <= len(d) <= 15:
        out.append("phone")
    if span[0] == "+":
        out.append("plus")
    if "(" in span:
        out.append("paren")
    if d and len(d) == len(span):
        out.append("plain")
    if len(d) < len(span) and any(c.isalpha() for c in span):
        out.append("letters")
        if len(span) >= 16 and re.fullmatch("[0-9a-f]+", span):
            out.append("hex")
    if span.count(".") > 3:
        out.append("many_dots")
    n = len(d)
    out.append("d0" if n == 0 else "d1" if n < 5 else "d5" if n < 7 else "d7" if n < 9 else "d9" if n < 12 else "d12" if n < 13 else "d13" if n < 20 else "d20")
    out.append("one" if tokens == 1 else "two" if tokens == 2 else "three" if tokens == 3 else "long")
    for w in before.split():
        k = CUES.get(w.strip(".,:;()=\"'").lower())
        if k is not None:
            out.append(f"cue{k}")
    if any("0" <= c <= "9" for c in beside):
        out.append("more_digits")
    return sorted({_F[f] for f in out})


#: Tokens whose segments are made at once; steps of the table that are held before what is certain is settled.
PIECE, KEPT = 128, 20_000


class Window:
    """Adjacent tokens of a text, and the segments that may be entities: (first, end, start, stop, features)."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.tokens, self.segments = tokens, []
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + LENGTH) + 1):
                a, b = tokens[i][0], tokens[j - 1][1]
                if b - a > LONGEST:
                    break
                raw = text[a:b]
                if j - i > 1 and "\n" in raw:
                    break
                m = EDGE.match(raw)
                lead = m.end() if m and m.start() == 0 else 0
                core = EDGE.sub("", raw)
                if not core or not (TRIGGER.search(core) or SPELT.search(core)):
                    continue
                s = a + (lead if raw[lead : lead + len(core)] == core else raw.find(core))
                e = s + len(core)
                if s >= tokens[i][1] or e <= tokens[j - 1][0]:
                    continue
                before = text[max(tokens[max(0, i - 2)][0], a - 2 * LONGEST) : a]
                self.segments.append((i, j, s, e, features(core, j - i, before, text[max(0, s - 1) : s] + text[e : e + 1])))


def _spelt(text: str) -> Iterator[int]:
    """Places in spelt-out addresses: the word for the at sign, and the one for the dot behind it."""
    for m in SAYS_AT.finditer(text):
        a, b = m.span()
        if dot := SAYS_DOT.match(text, b):
            yield a
            yield dot.end() - 1
        elif a and b < len(text) and not text[a - 1].isspace() and not text[b].isspace():
            yield a


def _marks(text: str) -> Generator[int, int, None]:
    """The first digit, at sign or spelt-out place at or after what is sent, again and again."""
    words = _spelt(text) if "dot" in text or "(at)" in text or "[at]" in text else iter(())
    word, upto = next(words, None), 0
    while True:
        while word is not None and word < upto:
            word = next(words, None)
        m = TRIGGER.search(text, upto)
        found = min((x for x in (word, m.start() if m else None) if x is not None), default=None)
        if found is None:
            return
        upto = yield found


def _token_before(text: str, at: int) -> int | None:
    """Where the token before the one that holds or begins at the place begins."""
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    while at > 0 and text[at - 1].isspace():
        at -= 1
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return at


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens near a digit, an at sign or a spelt-out address: AROUND tokens to each side. Each stretch of the text is read a bounded number of times."""
    marks, run, last = _marks(text), [], 0
    x = next(marks, None)
    while x is not None:
        a = x
        for _ in range(AROUND):
            if a <= last:
                break
            a = _token_before(text, a)
        while a > last and not text[a - 1].isspace():
            a -= 1
        own, after = [], 0
        for m in TOKEN.finditer(text, max(a, last)):
            own.append(m.span())
            after += m.start() > x
            if after > AROUND:
                break
        if run and text[run[-1][1] : own[0][0]].strip():
            yield run
            run = []
        run += own
        last = own[-1][1]
        try:
            x = marks.send(last)
        except StopIteration:
            break
    if run:
        yield run


class Field:
    """Weights of (kind, feature) and of a kind after another; kind 4 is none, and scores nothing."""

    def __init__(self):
        self.w, self.t = np.zeros((4, N)), np.zeros((5, 5))

    def scores(self, w: Window) -> np.ndarray:
        return np.array([self.w[:, f].sum(1) for *_, f in w.segments]) if w.segments else np.zeros((0, 4))

    def best(self, w: Window) -> list[tuple[int, int, int]]:
        """The entities (kind, start, stop) of the best sequence."""
        return self.joint([(0, 0, w)])

    def decode(self, text: str, run: list[tuple[int, int]], piece: int = PIECE, kept: int = KEPT) -> list[tuple[int, int, int]]:
        """The entities of the best sequence of a whole run, whose segments are made piece by piece."""
        starts = ((max(0, s - LENGTH - 2), s) for s in range(0, len(run), piece))  # two tokens before a segment are its context
        return self.joint(((lo, s, Window(text, run[lo : s + piece])) for lo, s in starts), kept)

    def joint(self, pieces: Iterable[tuple[int, int, Window]], kept: int = KEPT) -> list[tuple[int, int, int]]:
        """The best sequence over pieces (first token, first new token, window), which overlap by a segment.

        The table's last LENGTH columns go on from piece to piece. What all of their ways have in common is settled when
        more than `kept` steps are held, so memory doesn't grow with the run.
        """
        start = np.full(5, -np.inf)
        start[4] = 0
        top, back, settled, root, n = {0: start}, {}, [], (0, 4), 0

        def way(node: tuple[int, int]) -> list[tuple[int, int]]:
            out = [node]
            while out[-1] != root:
                out.append(back[out[-1]][:2])
            return out

        def entities(node: tuple[int, int]) -> list[tuple[int, int, int]]:
            return [(y, *back[j, y][2]) for j, y in reversed(way(node)) if (j, y) != root and back[j, y][2]]

        for lo, s, w in pieces:
            sc, by_end, n = self.scores(w), {}, lo + len(w.tokens)
            for k, x in enumerate(w.segments):
                by_end.setdefault(lo + x[1], []).append(k)
            for j in range(s + 1, n + 1):
                row = np.full(5, -np.inf)
                v = top[j - 1] + self.t[:, 4]
                row[4], back[j, 4] = v.max(), (j - 1, int(v.argmax()), None)
                for k in by_end.get(j, ()):
                    i = lo + w.segments[k][0]
                    v = top[i][:, None] + self.t[:, :4]
                    y = v.max(0) + sc[k]
                    for kind in range(4):
                        if y[kind] > row[kind]:
                            row[kind], back[j, kind] = y[kind], (i, int(v[:, kind].argmax()), w.segments[k][2:4])
                top[j] = row
                top.pop(j - LENGTH - 1, None)
            if len(back) > kept:
                ways = [way((j, y)) for j, row in top.items() for y in range(5) if row[y] > -np.inf]
                common = max(set(ways[0]).intersection(*ways[1:]))
                settled += entities(common)
                back, root = {x: v for x, v in back.items() if x[0] > common[0]}, common
        return settled + entities((n, int(top[n].argmax())))

    def gradient(self, w: Window, gold: dict[tuple[int, int], int], gw: np.ndarray, gt: np.ndarray) -> None:
        """Adds the gradient of the log-likelihood of gold, {(first, end): kind}."""
        n, sc = len(w.tokens), self.scores(w)
        steps: list[tuple[int, int, int]] = [(i, i + 1, -1) for i in range(n)] + [(s[0], s[1], k) for k, s in enumerate(w.segments)]
        steps.sort(key=lambda s: (s[1], s[0]))
        a = np.full((n + 1, 5), -np.inf)
        a[0, 4] = 0
        for i, j, k in steps:
            if k < 0:
                a[j, 4] = np.logaddexp(a[j, 4], np.logaddexp.reduce(a[i] + self.t[:, 4]))
            else:
                a[j, :4] = np.logaddexp(a[j, :4], np.logaddexp.reduce(a[i][:, None] + self.t[:, :4], axis=0) + sc[k])
        b = np.full((n + 1, 5), -np.inf)
        b[n] = 0
        for i, j, k in sorted(steps, key=lambda s: (-s[0], -s[1])):
            if k < 0:
                b[i] = np.logaddexp(b[i], self.t[:, 4] + b[j, 4])
            else:
                b[i] = np.logaddexp(b[i], np.logaddexp.reduce(self.t[:, :4] + (sc[k] + b[j, :4])[None, :], axis=1))
        z = np.logaddexp.reduce(a[n])
        for i, j, k in steps:
            if k < 0:
                gt[:, 4] -= np.exp(a[i] + self.t[:, 4] + b[j, 4] - z)
            else:
                p = np.exp(a[i][:, None] + self.t[:, :4] + (sc[k] + b[j, :4])[None, :] - z)
                gt[:, :4] -= p
                gw[:, w.segments[k][4]] -= p.sum(0)[:, None]
        at = {(s[0], s[1]): k for k, s in enumerate(w.segments)}
        i, last, ends = 0, 4, {first: (end, kind) for (first, end), kind in gold.items()}
        while i < n:
            end, kind = ends.get(i, (i + 1, 4))
            gt[last, kind] += 1
            if kind < 4:
                gw[kind, w.segments[at[i, end]][4]] += 1
            i, last = end, kind


def _rewritten(kind: int, s: str, k: int) -> str | None:
    d = digits_of(s)
    if kind == 0:
        name, _, host = s.partition("@")
        return (f"{name} at {host.replace('.', ' dot ')}", f"{name}[at]{host}", f"{name} @ {host}", f"{name} (at) {host.replace('.', ' (dot) ')}")[k % 4]
    if kind == 1:
        return s.replace(".", ("[.]", " . ")[k % 2])
    if kind == 2 and len(d) == 16:
        return ("./_"[k % 3]).join(d[x : x + 4] for x in range(0, 16, 4))
    if kind == 3 and len(d) >= 10:
        x, y, z = d[-10:-7], d[-7:-4], d[-4:]
        return (f"({x}) {y}-{z}", f"{x}-{y}-{z}", f"{x}.{y}.{z}", f"{x} {y} {z}")[k % 4]
    return None


def examples(text: str) -> Iterator[tuple[Window, dict[tuple[int, int], int]]]:
    spans = base_spans(text)

    def labelled(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[Window, dict[tuple[int, int], int]]]:
        by = {(a, b): kind for kind, a, b in spans}
        for run in windows(text):
            for s in range(0, len(run), 24):
                w = Window(text, run[s : s + 24])
                gold: dict[tuple[int, int], int] = {}
                for i, j, a, b, _ in w.segments:
                    if (a, b) in by and not any(i < y and x < j for x, y in gold):
                        gold[i, j] = by[a, b]
                if w.segments:
                    yield w, gold

    yield from labelled(text, spans)
    for n, (kind, a, b) in enumerate(spans[:4]):
        left, right = text[max(0, a - 60) : a], text[b : b + 60]
        for k in range(2):
            if other := _rewritten(kind, text[a:b], n + k + a):
                yield from labelled(left + other + right, [(kind, len(left), len(left) + len(other))])


#: The field is fitted on a bounded sample: so many texts, so many characters of each, so many windows; and rounds of training.
SAMPLE, SAMPLE_CHARS, EXAMPLES, EPOCHS = 300, 20_000, 900, 12


def fit(texts: list[str]) -> Field:
    """By AdaGrad, in a fixed order."""
    got: list = []
    for t in texts:
        got += examples(t[:SAMPLE_CHARS])
    got = got[:EXAMPLES]
    f = Field()
    # Where data are few, the field starts from what the kinds' own shapes say.
    for kind, name in enumerate(("email", "four_small", "luhn", "phone")):
        f.w[kind, _F[name]] = 4
        f.w[kind, _F["bias"]] = -3
    hw, ht = np.full((4, N), 1e-6), np.full((5, 5), 1e-6)
    for _ in range(EPOCHS):
        for s in range(0, len(got), 30):
            gw, gt = -0.02 * f.w, -0.02 * f.t
            for w, gold in got[s : s + 30]:
                f.gradient(w, gold, gw, gt)
            hw += gw**2
            ht += gt**2
            f.w += 0.5 * gw / np.sqrt(hw)
            f.t += 0.5 * gt / np.sqrt(ht)
    return f


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and added spans), both by kind and start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts, reach, most = [a for a, _ in taken], [], 0
    for _, b in taken:
        reach.append(most := max(most, b))  # how far the base spans up to this one reach
    added: list[tuple[int, int, int]] = []
    last = 0
    for run in windows(text):
        for kind, a, b in field.decode(text, run):
            k = int(np.searchsorted(starts, b))
            if a >= last and not (k and reach[k - 1] > a):
                added.append((kind, a, b))
                last = b
    return base, sorted(base + added)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    A null or empty text has no spans. Spans count code points; the end is exclusive. Added spans touch no base span
    and no other added span; they have at most LENGTH tokens and LONGEST characters. Base spans may be of any length,
    and a text of any length is read whole, in time in proportion to its length. The field is fitted on at most SAMPLE
    texts (those of the least hashes), SAMPLE_CHARS characters of each and EXAMPLES windows. Repeated rows and rows
    that share an id or have none each get their own row. Other columns, whatever their names, are not read. An empty
    table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The sample: those of the smallest hashes. Tasks send hashes to find the border, and only then its texts.
    rows = src.filter(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("doc_id", "text"))
    border = rows.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    field = fit([] if border is None else [r[0] for r in sorted(rows.filter(F.col("h") <= border).select(F.substring("text", 1, SAMPLE_CHARS), "h").limit(SAMPLE).collect(), key=lambda r: (r[1], r[0]))])
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        f = sent.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts, shas, told = [[], [], [], []], [], []
            for t in batch.column("text"):
                t = t.as_py() or ""
                base, spans = all_spans(t, f) if TRIGGER.search(t) or "dot" in t or "[at]" in t or "(at)" in t else ([], [])
                for k in range(4):
                    counts[k].append(sum(x[0] == k for x in base))
                shas.append(hashlib.sha256(written(base).encode()).hexdigest() if base else nothing)
                told.append(written(spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(told, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return src.mapInArrow(run, OUT)


def op3_semi_crf_pii(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))
