"""Records that hold template residue, filler, error messages or script notices where dialogue should be.

A positive-unlabelled naive Bayes over passages (cues; the whole text of a record without cues) is learned by expectation-maximization:
trusted records (fixed forms of placeholders, errors and filler throughout, or one line throughout; in the sample also words that no
other record knows) are positive for good; the passages of a sample of all records start as negative and get posteriors. What tells trusted records labels
them only: it is no feature, so lines, words, shapes, symbols and repetition as learned decide. Then every passage of every record is scored, and a record is found if at least `share` of its passages are residue.

Learning is bounded: at most `trusted` trusted records and about `sample` others, of either those with the lowest hashes of their keys.
Trusted records are looked for in all rows. Scoring covers all records, whole texts, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.subtitles import cues, repair
from framesift.session import spread

# Forms of unfilled placeholders.
PLACEHOLDERS = r"\{\{[^{}]*\}\}|<%[^%]*%>|\$\{[^{}]*\}|\[\[[^\[\]]*\]\]|\{%[^%]*%\}|#\{[^{}]*\}|%[A-Z_]{2,}%|\$[A-Z_]{2,}\$|__[A-Z0-9_]{2,}__|@@\w+@@|<<[A-Z_ ]+>>|\{\d\}|%\(\w+\)s|\[[A-Z_ ]+ HERE\]"
# How pages and programs report errors.
ERRORS = r"^(?:Error )?[45]\d\d[ :]|\"status\": ?[45]\d\d|^Traceback|<noscript>|^<(?:!doctype )?html|^Error [45]\d\d"
# Usual filler.
FILLERS = r"lorem ipsum|\b(?:sample|dummy|placeholder|filler) (?:text|line)|blindtext|platzhaltertext|texte? provisoire|faux texte|texto de (?:ejemplo|relleno|prueba)|văn bản mẫu|nội dung tạm|\binsert (?:\w+ )?(?:subtitle|text|title|caption)s? here|^(?:tbd|tbc|todo)\b|chưa dịch|text to follow|(?:subtitle|translation) (?:goes here|missing)|übersetzung fehlt|sous-titre à venir|traducción pendiente|pendiente de traducir|falta traducir"
FORMS = (re.compile(PLACEHOLDERS), re.compile(ERRORS), re.compile(FILLERS, re.I))
CANDIDATE = f"(?m:{PLACEHOLDERS}|{ERRORS})|(?im:{FILLERS})"  # of a whole file; as Arrow's regular expressions have it

_STYLE = re.compile(r"\{\\[^{}\n]*\}|</?[ibu]>|</?font[^<>\n]*>")
_EDGES = ".,;:!?\"'()…¡¿«»“”„-–—♪"
_SYMBOLS = re.compile(r"[{}<>%$#@\[\]_=|/\\]+")
_SAME = re.compile(r"(.)\1+")
_ADDRESS = re.compile(r"\w@\w+\.\w|^\W*(?:www\.|https?:)\w*")
_DIGITS = re.compile(r"\d+")
KINDS = 6  # of repetition


def passages(text: str) -> tuple[list[str], bool]:
    """The cues of a record, or its whole text, without styling; whether it has cues."""
    text = repair(text)
    found = cues(text)
    timed = found is not None
    found = found if timed else [text.strip()]
    if "{\\" in text or "<" in text:
        found = [_STYLE.sub("", p) for p in found]
    return found, timed


def trusted_record(text: str) -> bool:
    """Whether each passage of a record holds one of the fixed forms, or it is five cues or more of one line."""
    ps, _ = passages(text)
    return bool(ps) and (all(any(f.search(p) for f in FORMS) for p in ps) or len(ps) >= 5 and len(set(map(line, ps))) == 1)


def same_ends(text: str) -> bool:
    """Whether the first and the last cue may be one line, by the first lines of them as stored."""
    a, b = text.find("-->"), text.rfind("-->")
    if a == b:
        return False
    a, b = (line(_STYLE.sub("", text[text.find("\n", k) + 1 :][:60].partition("\n")[0])) for k in (a, b))
    return a.startswith(b) or b.startswith(a)


def may_be_trusted(texts: pa.Array) -> np.ndarray:
    """Of each text whether it may be a trusted record."""
    forms = pc.match_substring_regex(texts, CANDIDATE).to_numpy(zero_copy_only=False)
    return forms | np.fromiter((same_ends(t.as_py()) for t in texts), bool, len(texts))


def line(p: str) -> str:
    """A passage, numbers and white space aside."""
    return _DIGITS.sub("9", " ".join(p.split()))


def repetition(ps: list[str], timed: bool) -> tuple[list[str], list[int]]:
    """Of each passage its line and kind: 0 for a text without cues, 1 in a record of one cue or two different ones, 5 of the same two, else
    by the share of the record that is the same line: 2 under 0.4, 3 under 0.9, 4 from 0.9."""
    keys = list(map(line, ps))
    if len(ps) < 3:
        return keys, [0 if not timed else 5 if len(ps) == 2 and keys[0] == keys[1] else 1] * len(ps)
    n = Counter(keys)
    return keys, [2 if n[k] < 3 or n[k] < 0.4 * len(ps) else 3 if n[k] < 0.9 * len(ps) else 4 for k in keys]


def core(token: str) -> str:
    return _DIGITS.sub("9", token.strip(_EDGES).lower())


def features(token: str, known: set[str] | dict) -> list[str]:
    """The features of a token: the word if it is known, else its shape and ending; and its symbols."""
    if "�" in token or "?" in token[:-1].lstrip("¿"):
        return ["o:lost"]  # characters were lost, so the word can't be known
    if _ADDRESS.search(token):
        return ["o:address"]
    out = sorted({f"s:{_SAME.sub(r'\1\1', m[0])}" for m in _SYMBOLS.finditer(token)})
    if len(token) > 1 and token.isupper():
        out.append("c:u")
    word = core(token)
    if word in known:
        out.append(f"w:{word}")
    elif word:
        bare = token.strip(_EDGES)
        shape = "9" if any(c.isdigit() for c in bare) else "l" if bare.islower() else "u" if bare.isupper() else "t" if bare.istitle() else "x"
        out += [f"o:{shape}", f"e:{shape}{word[-2:] if word.isalpha() else ''}"]
    return out


class Model:
    """Log-odds of words, of whole lines and of kinds of repetition for residue against dialogue."""

    def __init__(self, known: set[str], weight: dict[str, float], lines: dict[str, float], kinds: list[float], bias: float):
        self.known, self.weight, self.lines, self.kinds, self.bias = known, weight, lines, kinds, bias

    def scorer(self, size: int = 300_000) -> dict:
        """Token -> log-odds, of bounded size."""
        model = self

        class Scores(dict):
            def __missing__(self, token: str) -> float:
                s = sum(model.weight.get(f, 0.0) for f in features(token, model.known))
                if len(self) >= size:
                    self.clear()
                self[token] = s
                return s

        return Scores()

    def residue(self, ps: list[str], timed: bool, scores: dict) -> list[bool]:
        """Of each passage of a record whether it is residue."""
        lines = self.lines.get
        return [bool(p) and sum(map(scores.__getitem__, p.split())) + lines(k, 0.0) + self.kinds[r] + self.bias > 0 for p, k, r in zip(ps, *repetition(ps, timed), strict=True)]


def learn(trusted: list[str], others: list[str], rounds: int = 20, least: int = 3, smooth: float = 0.2) -> Model:
    """The model from the texts of trusted records and of a sample of all records.

    least: the records a word or line must occur in to be known. A sampled record is trusted, too, if four
    fifths of it are words in small letters that no other record knows. The same line counts once in a record. In each round, passages of records that aren't residue for
    the most part go back to dialogue: adverts and leftovers among dialogue are no residue."""
    records = []
    seen: Counter = Counter()  # in how many records
    lines: Counter = Counter()
    for t in [*trusted, *others]:
        ps, timed = passages(t)
        keys, kinds = repetition(ps, timed)
        n = Counter(keys)
        records.append([(p, k, n[k], r) for k, (p, r) in dict(zip(keys, zip(ps, kinds, strict=True), strict=True)).items() if p])
        seen.update({w for p in ps for w in p.split()})
        lines.update(n.keys())
    words: Counter = Counter()  # different spellings in one record count apart
    for w, n in seen.items():
        words[core(w)] += n
    known = {w for w, n in words.items() if n >= least and w}
    of: dict[str, list[str]] = {w: features(w, known) for w in seen}
    odd = {w for w, fs in of.items() if fs[:1] == ["o:l"] and w.strip(_EDGES).isalpha()}

    def unknown(ps: list[tuple]) -> bool:
        ws = [w for p, *_ in ps for w in p.split() if of[w] and of[w] != ["o:lost"]]
        return len(ws) >= 5 and sum(w in odd for w in ws) >= 0.8 * len(ws)

    ids: dict[str, int] = {}
    line_ids = {k: i for i, k in enumerate((k for k, n in lines.items() if n >= least), 1)}  # 0: any other
    flat, owner, positive, record, times, kind, whole = [], [], [], [], [], [], []
    for r, ps in enumerate(records):
        sure = r < len(trusted) or unknown(ps)
        for p, k, n, x in ps:
            fs = [f for w in p.split() for f in of[w]]
            flat += [ids.setdefault(f, len(ids)) for f in fs]
            owner += [len(record)] * len(fs)
            positive.append(sure)
            record.append(r)
            times.append(n)
            kind.append(x)
            whole.append(line_ids.get(k, 0))
    flat, owner, positive, record, times, kind, whole = (np.array(x, np.int64) for x in (flat, owner, positive, record, times, kind, whole))
    positive = positive.astype(bool)
    if not positive.any() or positive.all():
        return Model(known, {}, {}, [0.0] * KINDS, -1.0)
    size = np.bincount(record, times, len(records))
    z = positive.astype(np.float64)

    def log_odds(x: np.ndarray, n: int, z: np.ndarray) -> np.ndarray:
        one, zero = np.bincount(x, z, n) + smooth, np.bincount(x, 1 - z, n) + smooth
        return np.log(one / one.sum()) - np.log(zero / zero.sum())

    for _ in range(rounds):
        odds, kinds, wholes = log_odds(flat, len(ids), z[owner]), log_odds(kind, KINDS, z), log_odds(whole, len(line_ids) + 1, z)
        wholes[0] = 0.0
        bias = float(np.log((z.sum() + 1) / ((1 - z).sum() + 1)))
        score = np.bincount(owner, odds[flat], len(record)) + kinds[kind] + wholes[whole] + bias
        last, z = z, np.where(positive, 1.0, 1 / (1 + np.exp(-np.clip(score, -50, 50))))
        mostly = np.bincount(record, z * times, len(records)) >= 0.5 * size
        z = np.where(mostly[record] | positive, z, 0.0)
        if np.abs(z - last).max() < 1e-3:
            break
    return Model(known, {f: float(odds[i]) for f, i in ids.items()}, {k: float(wholes[i]) for k, i in line_ids.items()}, kinds.tolist(), bias)


def fit(df: DataFrame, key: str, text: str, trusted: int = 3000, sample: int = 6000) -> Model:
    """The model learned from bounded samples of the table: the trusted records and the others with the lowest hashes of their keys.

    A first pass counts the trusted records of all rows by leading zeros of their hash, which gives the hash below which there are at most
    `trusted` of them (all, if they are no more than that); a second one fetches these and the sample, about `sample` rows at any size."""
    rows = df.where(F.length(F.trim(text)) > 0).select(F.xxhash64(F.col(key).cast("string"), F.lit(1)).alias("h"), F.col(text).alias("text"))
    top = 63

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, top + 1), np.int64)
        for b in batches:
            n[0] += np.bincount(_zeros(b.column("h").to_numpy()), minlength=top + 1)
            b = b.filter(pa.array(may_be_trusted(b.column("text"))))
            for level, t in zip(_zeros(b.column("h").to_numpy()), b.column("text"), strict=True):
                n[1, level] += trusted_record(t.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], top + 1)), pa.array(np.tile(np.arange(top + 1), 2)), pa.array(n.ravel())], names=["kind", "level", "n"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy()
            b = b.append_column("sure", pa.array(_zeros(h) >= least)).append_column("other", pa.array(_low(h) < part))
            yield b.filter(pc.and_(b.column("other"), pc.invert(b.column("sure")))).select(["text", "sure", "other"])
            b = b.filter(b.column("sure"))
            sure = pa.array([x and trusted_record(t.as_py()) for x, t in zip(may_be_trusted(b.column("text")).tolist(), b.column("text"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("text"), sure, b.column("other")], names=["text", "sure", "other"]).filter(pc.or_(sure, b.column("other")))

    counts = np.zeros((2, top + 1), np.int64)
    counted = spread(rows).mapInArrow(count, "kind bigint, level bigint, n bigint").groupBy("kind", "level").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # 128 rows
        counts[r["kind"], r["level"]] = r["n"]
    above = np.cumsum(counts[1][::-1])[::-1]
    least = int(np.argmax(above <= trusted)) if (above <= trusted).any() else top
    part = min(1.0, sample / max(1, counts[0].sum()))
    got = spread(rows).mapInArrow(fetch, "text string, sure boolean, other boolean").toArrow()  # about trusted + sample rows
    got = got.to_pylist()
    return learn(sorted(r["text"] for r in got if r["sure"])[:trusted], sorted(r["text"] for r in got if r["other"]))


def _low(h: np.ndarray) -> np.ndarray:
    """The hash as a number from 0 to 1, of other bits than _zeros."""
    return (h & 0xFFFFFFFF) / 2**32


def _zeros(h: np.ndarray) -> np.ndarray:
    """Zeros ahead of the first bit set in the high half of the hash, up to 32."""
    high = (h.view(np.uint64) >> np.uint64(32)).astype(np.float64)
    return 32 - np.frexp(high)[1].astype(np.int64)


def residue_records(df: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.5, model: Model | None = None) -> DataFrame:
    """`key`, `passages`, `residue` of each record of whose passages at least `share` are residue.

    Null, empty and blank texts are never found; nor are rows with a null key. Repeated rows come out repeatedly. An empty table gives
    no rows."""
    model = model or fit(df, key, text)
    shared = df.sparkSession.sparkContext.broadcast((model.known, model.weight, model.lines, model.kinds, model.bias))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        scores = m.scorer()
        for b in batches:
            at, counts, hits = [], [], []
            for i, t in enumerate(b.column(1)):
                ps, timed = passages(t.as_py())
                n = sum(m.residue(ps, timed, scores))
                if n and n >= share * len(ps):
                    at.append(i)
                    counts.append(len(ps))
                    hits.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(counts, pa.int32()), pa.array(hits, pa.int32())], names=[key, "passages", "residue"])

    rows = df.where(F.col(key).isNotNull() & (F.length(F.trim(text)) > 0)).select(key, text)
    return spread(rows).mapInArrow(run, f"`{key}` {kind}, passages int, residue int")
