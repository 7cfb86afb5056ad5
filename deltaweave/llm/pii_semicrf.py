"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

Base spans come from four patterns with their checks (parts of an address up to 255, Luhn, digit counts). Between
them, zones of text around digits, at-signs and spelled-out ones (a bracketed "at", or the word before a dotted name) are cut into
tokens, every run of tokens that could be an entity (at most `MOST` that aren't blanks) becomes a candidate segment for each type it
fits, and features of the whole segment score it: form of its separators, digit count, checks passed, cue words before it, what touches it.
No type can match a text without such a place, and zones end at blanks, so nothing else needs scoring. Dynamic programming over the zone chooses
boundaries and types together; a segment is added if its posterior reaches `sure` and it doesn't touch
a base span.

The field is trained by conditional likelihood on zones (at most `2 * most_zones` examples, each of at most `zone_chars` characters and
`zone_segments` candidates; these bound the fit only) of about `sample` texts (chosen by a hash of their id, at most `most_chars` long), with base spans as entities and rewritten base spans (spelled-out at-signs, other separators, missing plus)
as further examples. Scoring is one pass over whole texts without a shuffle; memory is a zone's.

Defined cases: null texts are empty and have no spans; repeated rows get equal spans; an empty table gives no rows; without any
base span in the sample nothing is added; columns other than those named are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.common import bounded_sample, table

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: Where an entity can be: no form that `fits` admits is without one of these.
_TRIGGER = re.compile(r"[0-9@]|[\[(] ?[aA][tT] ?[\])]|(?<= )[aA][tT] (?=[A-Za-z0-9-]+(?:\.[A-Za-z]| ?[\[(]? ?[dD][oO][tT]\b))")
_AT = re.compile(r"[\[(] ?at ?[\])]| at ", re.I)
_SPELLED = re.compile(r"[a-z0-9._%+-]+(?: ?[\[(] ?at ?[\])] ?| at |@)[a-z0-9-]+(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[a-z0-9-]+)+", re.I)
_DOT = re.compile(r" ?[\[(]? ?dot ?[\])]? ?[a-z]", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
MOST, REACH = 16, 40
#: Words that announce an entity. Fixed values.
CUES = {EMAIL: ("mail", "email", "e-mail", "contact"), IP: ("ip", "host", "address", "server"), CARD: ("card", "visa", "pay", "karte", "tarjeta", "carte"), PHONE: ("phone", "tel", "call", "fax", "mobile", "telefon", "teléfono", "téléphone")}

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _part(digits: str) -> bool:
    """Whether a part of an address is at most 255, however many zeros lead it."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, leftmost and not overlapping for each kind; failing ones are dropped."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # a match holds exactly one at-sign, so each decides about itself
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            out.append((EMAIL, start, free))
        at = text.find("@", at + 1)
    out += [(IP, *m.span()) for m in _IP.finditer(text) if all(_part(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, *m.span()))
    if "+" in text:
        out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def zones(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Ranges around places where an entity can be, outside the spans `taken`; they end at blanks, so no word is cut."""
    found: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if found and m.start() - found[-1][1] <= REACH:
            found[-1][1] = m.end()
        else:
            found.append([m.start(), m.end()])
    held = sorted((s, e) for _, s, e in taken)
    done = 0
    for lo, hi in found:
        lo, hi = max(0, lo - REACH), min(len(text), hi + REACH)
        if hi <= done:  # the zone before has grown over it
            continue
        while lo > done and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        lo, done = max(lo, done), hi
        at = lo
        for s, e in held:
            if e <= at or s >= hi:
                continue
            if s > at:
                yield at, s
            at = max(at, e)
        if at < hi:
            yield at, hi


def _scored(zone: str) -> bool:
    """Whether any type could match in the zone: all but e-mails have four digits or more."""
    return "@" in zone or _AT.search(zone) is not None or sum(c in "0123456789" for c in zone) >= 4


def fits(kind: int, text: str) -> bool:
    """Whether a segment could be of the type at all."""
    if kind == EMAIL:
        return len(text) > 5 and ("@" in text or _AT.search(text) is not None) and ("." in text or "dot" in text.lower()) and not text[0].isspace()
    n = sum(c in "0123456789" for c in text)
    if not text[-1].isdigit() or not (text[0].isdigit() or text[0] in "+("):
        return False
    if any(c.isalpha() for c in text):
        return kind == IP and re.fullmatch(r"[0-9]{1,3}(?: ?[\[(]?(?:dot|\.)[\])]? ?[0-9]{1,3}){3}", text) is not None
    if kind == IP:
        return re.fullmatch(r"[0-9]{1,3}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}", text) is not None
    return 13 <= n <= 19 if kind == CARD else 7 <= n <= 15


def shape(text: str) -> str:
    """Runs of letters and digits by size, separators as they are."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 9)), text.lower()))


def segment_features(kind: int, zone: str, lo: int, hi: int) -> list[str]:
    text = zone[lo:hi]
    before, after = zone[max(0, lo - 24) : lo], zone[hi : hi + 2]
    digits = "".join(c for c in text if c in "0123456789")
    k = KINDS[kind]
    out = [k, f"{k} sep {''.join(sorted(set(re.sub(r'[^\W_]', '', text))))}"]
    if kind != EMAIL:
        out += [f"{k} n{len(digits)}", f"{k} shape {shape(text)}"]
    if before and (before[-1].isalnum() or before[-1] in "_+/="):
        out.append(f"{k} joined before")
    elif before and before[-1] in ".-#$*%&" and not before[-1].isspace():
        out.append(f"{k} mark before")
    if after and (after[0].isalnum() or after[0] in "_/="):
        out.append(f"{k} joined after")
    elif len(after) == 2 and after[0] in ".-" and after[1].isalnum():
        out.append(f"{k} goes on")
    if any(c in before.lower() for c in CUES[kind]):
        out.append(f"{k} cue")
    if kind == CARD:
        out.append(f"card luhn {luhn(digits)}")
    elif kind == IP:
        out.append(f"ip parts {all(int(p) <= 255 for p in re.findall('[0-9]+', text))}")
    elif kind == PHONE:
        out += [f"phone plus {text[0] == '+'}", f"phone lines {chr(10) in text}", f"phone card {13 <= len(digits) <= 19 and luhn(digits)}"]
    else:
        out += [f"email form {_SPELLED.fullmatch(text) is not None}", f"email dot after {_DOT.match(zone, hi) is not None}"]
        out += [f"email at {text.count('@')}", f"email spaces {min(7, len(text.split()) - 1)}", f"email end {bool(re.search(r'(?:[.]|dot[])]?) ?[A-Za-z]{2,6}$', text))}", f"email line {chr(10) in text}"]
    return out


def lattice(zone: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Token bounds, and candidate segments (kind, first token, end token)."""
    bounds = [m.start() for m in _TOKEN.finditer(zone)] + [len(zone)]
    n = len(bounds) - 1
    out = []
    for i in range(n):
        if zone[bounds[i]].isspace():
            continue
        held = 0
        for j in range(i + 1, n + 1):
            if zone[bounds[j] - 1].isspace():
                continue
            held += 1
            if held > MOST:
                break
            text = zone[bounds[i] : bounds[j]]
            out += [(k, i, j) for k in range(4) if fits(k, text)]
    return bounds, out


class SemiCrf:
    """Weights by feature; a token outside scores 0."""

    def __init__(self, weights: dict[str, float] | None = None, sure: float = 0.75):
        self.weights, self.sure = weights or {}, sure

    def scored(self, zone: str) -> tuple[list[int], list[tuple[int, int, int, float, list[str]]]]:
        bounds, segments = lattice(zone)
        out = []
        for k, i, j in segments:
            own = segment_features(k, zone, bounds[i], bounds[j])
            out.append((k, i, j, sum(self.weights.get(f, 0.0) for f in own), own))
        return bounds, out

    @staticmethod
    def sums(n: int, segments: list) -> tuple[list[float], list[float]]:
        """Log sums over all segmentations before and after each token bound."""
        by_end, by_start = defaultdict(list), defaultdict(list)
        for s in segments:
            by_end[s[2]].append(s)
            by_start[s[1]].append(s)
        fore, back = [0.0] * (n + 1), [0.0] * (n + 1)
        for t in range(1, n + 1):
            fore[t] = _log_sum([fore[t - 1]] + [fore[s[1]] + s[3] for s in by_end[t]])
        for t in range(n - 1, -1, -1):
            back[t] = _log_sum([back[t + 1]] + [back[s[2]] + s[3] for s in by_start[t]])
        return fore, back

    def best(self, zone: str) -> list[Span]:
        """The best segmentation's entities whose posterior is sure enough."""
        bounds, segments = self.scored(zone)
        if not segments:
            return []
        n = len(bounds) - 1
        by_end = defaultdict(list)
        for s in segments:
            by_end[s[2]].append(s)
        value, choice = [0.0] * (n + 1), [None] * (n + 1)
        for t in range(1, n + 1):
            value[t] = value[t - 1]
            for s in by_end[t]:
                if value[s[1]] + s[3] > value[t]:
                    value[t], choice[t] = value[s[1]] + s[3], s
        fore, back = self.sums(n, segments)
        out, t = [], n
        while t > 0:
            s = choice[t]
            if s is None:
                t -= 1
                continue
            if math.exp(min(0.0, fore[s[1]] + s[3] + back[s[2]] - fore[n])) >= self.sure:
                out.append((s[0], bounds[s[1]], bounds[s[2]]))
            t = s[1]
        return out[::-1]

    def spans(self, text: str | None) -> list[tuple[int, int, int, bool]]:
        """kind, start, end, whether a base span; by kind, then start."""
        if not text or not _TRIGGER.search(text):
            return []
        base = base_spans(text)
        out = [(*s, True) for s in base]
        if self.weights:
            for lo, hi in zones(text, base):
                zone = text[lo:hi]
                if _scored(zone):
                    out += [(k, lo + s, lo + e, False) for k, s, e in self.best(zone)]
        return sorted(out)


def _log_sum(xs: list[float]) -> float:
    m = max(xs)
    return m if len(xs) == 1 else m + math.log(sum(math.exp(x - m) for x in xs))


def rewritten(kind: int, text: str, rng: random.Random) -> str:
    """The same entity in a form that the patterns don't match."""
    if kind == EMAIL:
        user, _, host = text.partition("@")
        return user + rng.choice([" [at] ", " (at) ", "[at]", " at "]) + host.replace(".", rng.choice([" [dot] ", " dot ", "."]))
    if kind == IP:
        return text.replace(".", rng.choice(["[.]", " . ", "(.)"]))
    if kind == CARD:
        digits = re.sub("[ -]", "", text)
        return rng.choice([".", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    digits = re.sub("[^0-9]", "", text)[-10:]
    return f"({digits[:3]}) {digits[3:6]}-{digits[6:]}" if rng.random() < 0.5 else f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"


def fit(texts: list[str], *, rounds: int = 8, rate: float = 0.3, ridge: float = 1e-3, most_zones: int = 600, zone_chars: int = 600, zone_segments: int = 400, seed: int = 3) -> SemiCrf:
    rng = random.Random(seed)
    examples: list[tuple[str, set[Span]]] = []
    plain = 0
    for text in texts:
        if len(examples) >= 2 * most_zones:
            break
        base = [s for s in base_spans(text)]
        apart = [s for s in base if not any(o != s and o[1] < s[2] and s[1] < o[2] for o in base)]
        for lo, hi in zones(text, []):
            own = [(k, s - lo, e - lo) for k, s, e in apart if lo <= s and e <= hi]
            if len(own) != sum(1 for _, s, e in base if s < hi and e > lo) or hi - lo > zone_chars:
                continue
            if not own:
                if not _scored(text[lo:hi]) or plain > most_zones // 2:
                    continue
                plain += 1
            examples.append((text[lo:hi], set(own)))
            for k, s, e in own[:1]:
                new = rewritten(k, text[lo + s : lo + e], rng)
                if len(own) == 1:
                    cue = rng.choice(["", "", rng.choice(CUES[k]) + ": "])
                    head = text[lo : lo + s] + cue
                    examples.append((head + new + text[lo + e : hi], {(k, len(head), len(head) + len(new))}))
    if not any(g for _, g in examples):
        return SemiCrf()
    # Where learning begins: entities are rare, and a spelled-out address is a whole one.
    model = SemiCrf({k: -1.0 for k in KINDS} | {"email form False": -3.0, "email dot after True": -3.0, "email form True": 2.0})
    w = model.weights
    ready = []
    for zone, gold in examples:
        bounds, segments = lattice(zone)
        if not segments or len(segments) > zone_segments:
            continue
        ready.append((len(bounds) - 1, [(k, i, j, segment_features(k, zone, bounds[i], bounds[j]), (k, bounds[i], bounds[j]) in gold) for k, i, j in segments]))
    for r in range(rounds):
        rng.shuffle(ready)
        step = rate / (1 + r / 2)
        for n, own in ready:
            segments = [(k, i, j, sum(w.get(f, 0.0) for f in fs)) for k, i, j, fs, _ in own]
            fore, back = SemiCrf.sums(n, segments)
            for (k, i, j, s), (_, _, _, fs, is_gold) in zip(segments, own):
                g = is_gold - math.exp(min(0.0, fore[i] + s + back[j] - fore[n]))
                if abs(g) > 1e-4:
                    for f in fs:
                        w[f] = w.get(f, 0.0) * (1 - step * ridge) + step * g
    return model


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000, most_chars: int = 20_000) -> SemiCrf:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull())
    chosen = bounded_sample(rows, sample, id_col="_id", also=F.col("_text").rlike("[0-9@]") & (F.length("_text") <= most_chars))
    rows = sorted(chosen.collect(), key=lambda r: r._id)
    return fit([r._text for r in rows])


SPANS = "array<struct<kind: string, start: bigint, `end`: bigint, base: boolean>>"


def find(docs: DataFrame, model: SemiCrf, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, masked: bool = False) -> DataFrame:
    """doc_id, the columns of `keep` and spans (by kind, then start); with `masked` also masked_text with [KIND] for each span."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some hundred weights
    keep = list(keep or [])
    kept = [f"_keep_{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(k) for c, k in zip(keep, kept)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column("_text").to_pylist()
                spans = [m.spans(t) for t in texts]
                own = [b.column(c) for c in ["_id", *kept]] + [pa.array([[{"kind": KINDS[k], "start": s, "end": e, "base": f} for k, s, e, f in x] for x in spans], kind)]
                if masked:
                    own.append(pa.array([mask(t, x) for t, x in zip(texts, spans)], pa.string()))
                yield pa.RecordBatch.from_arrays(own, ["_id", *kept, "_spans", "_masked"][: len(own)])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in ["_id", *kept]) + f", _spans {SPANS}" + ", _masked string" * masked)
    return out.select(F.col("_id").alias("doc_id"), *[F.col(k).alias(c) for k, c in zip(kept, keep)], F.col("_spans").alias("spans"), *[F.col("_masked").alias("masked_text")] * masked)


def mask(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    """Spans replaced by their kind; of overlapping ones the whole range by the first's kind."""
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e, _ in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, train(docs))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *map(count, KINDS), added, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
