"""Operator 4, secret scans.

Three fixed pattern kinds (assign, access, hex) and spans found by two character
Markov models: order-2 models of random strings and of ordinary identifiers are
trained from labelled samples; a candidate token is a secret (kind ``markov``)
if the mean log-likelihood ratio per character of the whole, or of one of its
parts of 16 characters or more between separators, is over a threshold and base
spans don't cover all of it. Identifiers in the form of a UUID are samples of
ordinary ones. Digests of public files are as random as keys, so they are
reported.

Defined results: a null or empty text has no spans; a token of any length is
judged whole, in time in proportion to it; overlapping spans are all reported,
by start, then kind; repeated rows give equal rows; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from orograph.llm.common import map_rows, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: Runs are maximal, so the length can stand in the pattern: shorter matches are the ones that the contract drops.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Tokens that the models judge: every run of 16 characters or more, however long and of whatever characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "markov": 3}

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LETTERS = len(ALPHABET) + 1  # one more for any other character and the start
PARTS = "get set add new old max min user name file path data list item node index count size key value table row column query filter sort order group join merge split load save read write open close start stop run init build make test check find search match replace insert update delete remove create page view form field input output error warn info debug log time date day week month year hour minute second local remote host port server client request response header body status code message event handler listener manager factory service config option setting default static final public private class object array string number float double int long bool map set queue stack tree graph edge vertex matrix vector image video audio text font color width height left right top bottom center".split()
#: Pieces of words in the languages of usual corpora; long words and compounds are put together from them.
PIECES = "the ing tion ation ment ness able ible less ful ship ward inter trans over under counter micro multi super anti auto bio geo photo graph phone scope logy logical ism ist ity ous ive ance ence ize ized ization er ers or al ly un re de dis pre pro con com per sub ex en in im non out up down land house work man stone water light ground book school way side time line fall wind mill comp respons commun inform develop govern environ establish represent understand consider friend question straight strength thought through knowledge der die das und ein eine einer einem nicht ver be ge zer ent er auf aus ab an bei vor nach zu zum ung ungen heit keit lich lichkeit schaft schaften isch ieren chen lein bar sam los haft tum nis schiff fahrt gesell recht rechts steuer haupt bahn hof stadt straße strasse wasser arbeit arbeits zeit geschwindig begrenz versicher verwalt bund bundes land wirt kraft werk zeug fahr zug kranken haus kind garten schul lehr buch sprach wissen technik pfleg pfl sch tz st sp kn qu pf ich ach och auch doch durch zwischen les des est pas que qui une dans pour avec sur eux aux eau eaux elle elles ette tion sion ment ments ique able eur euse esse age ance aient aire oir oire ille ouille ou oui oue ai au ail ch chou cha che bou bre tre ple ier iere constitution anticipation gouverne développe developpe administr intern nation alis el los las una con por para mente mento cion ciones ado ada ados adas ando iendo idad idades ista ismo able ible ero era ería eria ura oso osa des en em sobre entre contra trans desarroll conoci respons interna cional ra re ri ro ru ma me mi mo la le li lo ta te ti to ca co ci ce cu sa se si so na ne ni no pa pe pi po ba be bi bo da de di do ga go gue gui ja jo lla llo ña vi va za zo".split()
#: The threshold on the mean log-likelihood ratio per character, that of runs of letters alone (rare words of any language come near random ones; of random letters 96 to 99 % of runs lie above), and samples a class.
THRESHOLD, LETTERS_THRESHOLD, SAMPLES = 0.45, 1.3, 4000


def labelled_samples(n: int = SAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """(string, 1 for a random one): keys over usual alphabets; identifiers, paths, versions and dates in usual styles."""
    rng = np.random.default_rng(seed)
    pools = [ALPHABET[:62], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:64], ALPHABET]
    out = [("".join(rng.choice(list(pools[i % len(pools)]), int(rng.integers(16, 48)))), 1) for i in range(n)]
    for i in range(n):
        words = [str(w) for w in rng.choice(PARTS, int(rng.integers(3, 7)))]
        number = str(rng.integers(0, 10 ** int(rng.integers(1, 5))))
        style = i % 7
        if style == 6:
            digits = "".join(rng.choice(list("0123456789abcdef"), 32))
            s = "-".join(digits[a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))
        elif style == 0:
            s = "_".join([*words, number])
        elif style == 1:
            s = words[0] + "".join(w.capitalize() for w in words[1:]) + number
        elif style == 2:
            s = "/".join(words) + "/" + number
        elif style == 3:
            s = "-".join(words) + f"-{rng.integers(1990, 2035)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}"
        elif style == 4:
            s = "_".join(words).upper() + "_" + number
        else:
            s = "".join(words) + number
        out.append((s, 0))
    return out


def plain_samples(n: int = SAMPLES, seed: int = 11) -> list[tuple[str, int]]:
    """(string, 1 for a random one) of what has no letters or no digits: keys of letters; long words, their rows, separators and numbers."""
    rng = np.random.default_rng(seed)
    pieces = [p for p in PIECES if p.isascii()]
    pools = [ALPHABET[:26], ALPHABET[26:52], ALPHABET[:52]]
    out = [("".join(rng.choice(list(pools[i % len(pools)]), int(rng.integers(16, 48)))), 1) for i in range(n)]
    for i in range(4 * n):
        word = "".join(str(p) for p in rng.choice(pieces, int(rng.integers(4, 9))))
        style = i % 8
        if style < 4:
            s = word
        elif style == 4:
            s = word.capitalize()
        elif style == 5:
            s = word.upper()
        elif style == 6:
            s = str(rng.choice(["-", "_", "/", "="])).join("".join(str(p) for p in rng.choice(pieces, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(3, 7))))
        elif i % 32 == 7:
            s = "".join(rng.choice(list("+/_=-"), int(rng.integers(1, 4)))) * int(rng.integers(16, 81))
        elif i % 32 == 15:
            s = str(rng.choice(list(ALPHABET))) * int(rng.integers(16, 81))
        else:
            s = "".join(rng.choice(list("0123456789"), int(rng.integers(16, 33))))
        out.append((s, 0))
    return out


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], LETTERS - 1)


_CODE = np.full(128, LETTERS - 1)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def train(samples: list[tuple[str, int]]) -> np.ndarray:
    """Log-likelihood ratio random : ordinary of each character after two others, with add-half smoothing towards order 1."""
    logs = []
    for label in (0, 1):
        three = np.zeros((LETTERS, LETTERS, LETTERS))
        for s, y in samples:
            if y == label:
                c = np.concatenate([[LETTERS - 1, LETTERS - 1], codes(s)])
                np.add.at(three, (c[:-2], c[1:-1], c[2:]), 1)
        two = three.sum(0) + 0.5 / LETTERS
        one = (two.sum(0) + 1) / (two.sum() + LETTERS)
        two = (two + 4 * one) / (two.sum(1, keepdims=True) + 4)
        logs.append(np.log((three + 8 * two[None]) / (three.sum(2, keepdims=True) + 8)))
    return logs[1] - logs[0]


@lru_cache(1)
def model() -> np.ndarray:
    return train(labelled_samples() + plain_samples())


def ratio(token: str, llr: np.ndarray) -> float:
    """Mean log-likelihood ratio per character."""
    c = np.concatenate([[LETTERS - 1, LETTERS - 1], codes(token)])
    return float(llr[c[:-2], c[1:-1], c[2:]].mean()) if len(c) > 2 else 0.0


#: Parts of a token between separators.
SEPARATED = re.compile(r"[A-Za-z0-9+]{16,}")


def is_random(token: str, llr: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether a token, or a part of it between separators, is likelier a random string."""
    least = lambda run: max(threshold, LETTERS_THRESHOLD) if run.isalpha() else threshold
    return ratio(token, llr) > least(token) or any(m[0] != token and ratio(m[0], llr) > least(m[0]) for m in SEPARATED.finditer(token))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the contract's kinds, by start, then kind."""
    out = []
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def united(base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the base spans (by start) hold together, as spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, _, b in base:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def spans(text: str, llr: np.ndarray, threshold: float = THRESHOLD) -> tuple[list, list]:
    """Base spans; all spans, with those that the models add."""
    base = base_spans(text)
    held, at, found = united(base), 0, []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        # Runs and what the base holds both ascend: one pass over either.
        while at < len(held) and held[at][1] < e:
            at += 1
        if not (at < len(held) and held[at][0] <= s) and is_random(m[0], llr, threshold):
            found.append((s, 3, e))
    return base, sorted(base + found)


NAMES = list(KINDS)
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def scan(texts: list[str | None]) -> list[tuple]:
    llr = model()
    out = []
    for raw in texts:
        base, every = spans(raw or "", llr)
        joined = ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in base)
        kinds = [k for _, k, _ in every]
        out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined.encode()).hexdigest(), ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in every), kinds.count(3)))
    return out


def secret_scan(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Secret spans of each row: a map without a shuffle."""
    return map_rows(df, scan, keys, text, SCHEMA)


def redact(texts: list[str | None], mark: str = "[SECRET]") -> list[tuple]:
    """Each text with its spans replaced by ``mark`` (overlapping spans by one)."""
    llr = model()
    out = []
    for raw in texts:
        if raw is None:
            out.append((None,))
            continue
        _, every = spans(raw, llr)
        pieces, at = [], 0
        for s, _, e in every:
            if s >= at:
                pieces += [raw[at:s], mark]
            at = max(at, e)
        out.append(("".join([*pieces, raw[at:]]) if every else raw,))
    return out


def redacted(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return map_rows(df, redact, keys, text, "text string")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op4_secret_scan": op4_secret_scan}
