"""Personal data by weak supervision.

Regular expressions for e-mail, IP, card and phone numbers find the base spans, which always stay. Beside them, generators propose looser candidates of
each kind (spelt-out addresses, bracketed and colon IPs, cards with other separators or a wrong check digit, national phone numbers) and assigned secrets (a
kind of its own, reported in columns of its own). Labelers of six kinds - strict pattern, check rule, gazetteer, context word, counter word, shape - each vote
+1, -1 or abstain on every span. Expectation-maximisation over the counts of vote patterns (a table of bounded size, whatever the corpus) estimates each
labeler's reliability without labels, from prior reliabilities, and gives each pattern a posterior. A logistic model over votes by kind, trained on those
posteriors, is the final span classifier: it alone decides which candidates become spans.

Offsets count code points, ends exclusive. Cases: null counts as empty; very long texts are read whole; repeated rows give repeated results; an empty table
trains on the prior reliabilities alone and gives no rows; extra columns are ignored; of overlapping candidates the earlier, then the longer one is judged.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

KINDS = ("email", "ip", "card", "phone")
#: Kinds that have no base pattern; their spans are in columns of their own.
MORE_KINDS = ("secret",)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A match can only begin where a run of digits does: from within it, the same dots follow. (The look-behind keeps long runs linear.)
#: Candidates beyond the base, each bounded in length.
AT = r"(?:\s?[\[({<]\s?(?:at|arroba|chez|ät|@)\s?[\])}>]\s?|\s(?:at|arroba|chez)\s|＠|&\#64;)"
DOT = r"(?:\s?[\[({<]\s?(?:dot|punkt|point|punto|\.)\s?[\])}>]\s?|\s(?:dot|punkt|point|punto)\s|\.)"
SPELT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.I)
SPELT_HINT = re.compile(r"[\[({<]\s?(?:at|arroba|chez|ät|@)\s?[\])}>]|\s(?:dot|punkt|point|punto)\s|＠|&\#64;", re.I)
BROKEN_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\s?[0-9]{1,3}|\.[0-9]{1,3}){3}(?![0-9])", re.I)
IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])")
LOOSE_CARD = re.compile(r"(?<![0-9.+-])[0-9]{4}(?P<s>[\x20._/\u00a0\u2009-]{0,3})[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{1,7}(?![0-9])|(?<![0-9.+-])3[0-9]{3}(?P<t>[\x20._/\u00a0-]{1,3})[0-9]{6}(?P=t)[0-9]{5}(?![0-9])")
NATIONAL = re.compile(
    r"(?<![0-9.+/-])(?:\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}|0[1-9](?:[\x20.-][0-9]{2}){4}|0[1-9][0-9]{1,4}[\x20/-]{1,3}[0-9]{3,4}[\x20-]?[0-9]{2,5}|[6789][0-9]{2}(?:[\x20.-][0-9]{3}){2}|[6789][0-9]{2}(?:[\x20.-][0-9]{2}){3}|00[1-9][0-9]{0,2}(?:[\x20.-]?[0-9]{2,4}){3,5})(?![0-9-])"
)
SECRET = re.compile(
    r"(?i:\b(?:api[_ -]?key|access[_ -]?key|auth|bearer|client[_ -]?secret|key|passw(?:or)?d|passwort|pwd|secret|token|clave|contraseña|mot de passe|kennwort|schlüssel)\b)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<v>[A-Za-z0-9+/_.~-]{8,256})|(?<![A-Za-z0-9])(?P<w>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[abp]-[A-Za-z0-9-]{10,64}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,512}\.[A-Za-z0-9_-]{10,512})"
)
SECRET_HINT = re.compile(r"[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.~-]{8}|AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|AIza|eyJ")

#: Common top-level domains, mail providers, issuer ranges of cards (prefix from, to, lengths), calling codes, and context words in four languages.
DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro io ai app dev co me tv xyz online site eu uk de fr es it nl be ch at lu se no fi dk is ie pt pl cz sk hu ro bg gr hr si rs ua ru by tr il ae sa eg za ng ke ma cn jp kr tw hk sg my th vn id ph in pk au nz ca us mx br ar cl pe uy ve cu cat".split()
)
PROVIDERS = frozenset("gmail googlemail hotmail outlook live msn yahoo ymail icloud me aol gmx web t-online freenet orange wanadoo free laposte sfr telefonica terra movistar protonmail proton mail yandex".split())
ISSUERS = (
    (4, 4, (13, 16, 19)), (51, 55, (16,)), (2221, 2720, (16,)), (34, 34, (15,)), (37, 37, (15,)), (300, 305, (14, 16)), (36, 36, (14, 16)), (38, 39, (14, 16)),
    (6011, 6011, (16, 19)), (644, 649, (16, 19)), (65, 65, (16, 19)), (3528, 3589, (16, 19)), (62, 62, (16, 17, 18, 19)), (50, 50, (13, 16, 19)), (56, 58, (13, 16, 19)), (63, 63, (16, 19)), (67, 67, (16, 19)),
)
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 221 225 233 234 237 254 255 256 351 352 353 354 356 357 358 359 370 371 372 380 381 385 386 420 421 880 886 961 962 965 966 971 972 974".split())
NEAR = {
    "email": frozenset("email mail e-mail contact contacts write reach address correo correos courriel contacter contacto kontakt kontaktieren schreiben adresse adresser dirección escribir".split()),
    "ip": frozenset("ip ipv4 ipv6 address host server login client adresse serveur hôte rechner servidor dirección anfitrión connexion verbindung conexión".split()),
    "card": frozenset("card cards credit debit visa mastercard amex payment pay karte kreditkarte zahlung carte crédit paiement bancaire tarjeta crédito pago cvv expires".split()),
    "phone": frozenset("phone call tel telephone mobile fax cell reach telefon handy anrufen rufnummer teléfono telefono móvil llamar llame téléphone portable appeler appelez".split()),
    "secret": frozenset("token secret password passwd pwd bearer credential credentials passwort kennwort geheim contraseña clave secreto mot passe jeton api".split()),
}
AGAINST = frozenset("version versión isbn issn doi order invoice page figure table section id no nr sha sha1 sha256 md5 commit checksum hash uuid serial rechnung bestellung seite abbildung facture commande numéro página figura pedido factura release".split())
WINDOW = 32


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def accepted(kind: str, match: str) -> bool:
    if kind == "ip":
        # a part of many digits is too large, whatever its length
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in match.split("."))
    if kind == "card":
        d = digits_of(match)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits_of(match)) <= 15
    return True


def emails(text: str) -> list[Span]:
    """Leftmost e-mail matches. A match holds no white space, so only words with an @ are searched."""
    out, at = [], text.find("@")
    while at >= 0:
        begin, end = at, at
        while begin > 0 and not text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        out += [Span("email", m.start(), m.end(), True) for m in local_matches(text, begin, end)]
        at = text.find("@", end)
    return out


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def local_matches(text: str, begin: int, end: int):
    """Leftmost matches in text[begin:end], anchored at each @ so that long words cost linear time."""
    upto, at = begin, text.find("@", begin, end)
    while at >= 0:
        first = at
        while first > upto and text[first - 1] in LOCAL:
            first -= 1
        m = EMAIL.match(text, first) if first < at else None
        if m:
            yield m
            upto = m.end()
            at = text.find("@", upto, end)
        else:
            at = text.find("@", at + 1, end)


HAS_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    if HAS_DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            if kind == "phone" and "+" not in text:
                continue
            out += [Span(kind, m.start(), m.end(), True) for m in pattern.finditer(text) if accepted(kind, m[0])]
    return out


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Looser spans that overlap no base span and no earlier candidate."""
    out = []
    if HAS_DIGIT.search(text):
        out += [Span("card", m.start(), m.end(), False) for m in LOOSE_CARD.finditer(text)]
        out += [Span("phone", m.start(), m.end(), False) for m in NATIONAL.finditer(text)]
        if "." in text:
            out += [Span("ip", m.start(), m.end(), False) for m in BROKEN_IP.finditer(text)]
        if ":" in text:
            out += [Span("ip", m.start(), m.end(), False) for m in IP6.finditer(text)]
    if SPELT_HINT.search(text):
        out += [Span("email", m.start(), m.end(), False) for m in SPELT.finditer(text)]
    if SECRET_HINT.search(text):
        for m in SECRET.finditer(text):
            group = "v" if m["v"] is not None else "w"
            out.append(Span("secret", m.start(group), m.end(group), False))
    taken = sorted((s.start, s.end) for s in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    kept, upto = [], 0
    for s in sorted(out, key=lambda s: (s.start, -s.end)):
        i = bisect_left(starts, s.end)
        if s.start >= upto and not (i and reach[i - 1] > s.start):
            kept.append(s)
            upto = s.end
    return kept


LABELERS = ("strict", "check", "gazetteer", "context", "counter", "shape")
#: P(the labeler says yes | personal data) and P(it says no | not), if it doesn't abstain, before any data are seen. The check rules differ in how much they
#: exclude: a card's check digit is right by chance on one in ten others, while any long number has a phone's number of digits.
CHECK_NO = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.5, "secret": 0.8}
PRIOR = {"strict": (0.6, 0.6), "check": (0.99, 0.9), "gazetteer": (0.8, 0.7), "context": (0.9, 0.9), "counter": (0.85, 0.85), "shape": (0.65, 0.65)}
#: Weight of the prior reliabilities, in spans, and as a share of a kind's spans.
PRIOR_SPANS, PRIOR_SHARE = 20.0, 1.0
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?[0-9]{0,3}")


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def issuer(digits: str) -> bool:
    return any(len(digits) in lengths and low <= int(digits[: len(str(low))]) <= high for low, high, lengths in ISSUERS)


def yes_no(flag: bool) -> int:
    return 1 if flag else -1


def of_email(body: str, strict: bool) -> tuple[int, int, int]:
    """(check, gazetteer, shape)."""
    labels = [x for x in re.split(r"[^a-z0-9-]+|\b(?:dot|punkt|point|punto|at|arroba|chez)\b", body.lower()) if x]
    tail = labels[-1] if labels else ""
    return yes_no(tail.isalpha() and 2 <= len(tail) <= 24), 1 if tail in DOMAINS or PROVIDERS & set(labels) else 0 if strict else -1, yes_no(len(body) <= 80 and len(labels) >= 3)


def of_ip(body: str, strict: bool) -> tuple[int, int, int]:
    if ":" in body:
        return yes_no(body.count("::") <= 1), 1 if body.lower().startswith(("2", "fe80", "fd", "fc")) else 0, 1 if body.count(":") == 7 else 0
    parts = re.findall(r"[0-9]+", body)
    small = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)
    return yes_no(small), -1 if not small or int(parts[0][-4:]) in (0, 255) else 1, yes_no(any(len(p) > 1 for p in parts))


def of_card(body: str, strict: bool) -> tuple[int, int, int]:
    d = digits_of(body)
    runs = [len(x) for x in re.findall(r"[0-9]+", body)]
    return yes_no(13 <= len(d) <= 19 and luhn(d)), yes_no(13 <= len(d) <= 19 and issuer(d)), 1 if runs in ([4, 4, 4, 4], [4, 6, 5]) or len(runs) == 1 and runs[0] in (15, 16) else 0


def of_phone(body: str, strict: bool) -> tuple[int, int, int]:
    d = digits_of(body)
    foreign = body.startswith(("+", "00"))
    bare = d[2:] if d.startswith("00") and not body.startswith("+") else d
    known = any(bare[:n] in CALLING for n in (1, 2, 3)) if foreign else d[0] in "06789" or len(d) == 10 and d[0] in "2345" and d[3] not in "01"
    return yes_no(9 <= len(d) <= 15), yes_no(known), 1 if re.search(r"[\x20().-]", body) else 0


def of_secret(body: str, strict: bool) -> tuple[int, int, int]:
    known = bool(re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|AIza|eyJ", body)) or bool(re.fullmatch(r"(?i)[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}", body))
    mixed = bool(re.search(r"[0-9]", body)) and bool(re.search(r"[A-Za-z]", body))
    return yes_no(len(body) >= 12 and mixed and entropy(body) >= 3.0), 1 if known else 0, 1 if mixed else -1


RULES = {"email": of_email, "ip": of_ip, "card": of_card, "phone": of_phone, "secret": of_secret}


def votes(text: str, s: Span) -> tuple[int, ...]:
    """A vote of each labeler: 1 personal data, -1 not, 0 abstains."""
    before = {w.lower() for w in WORD.findall(text[max(0, s.start - WINDOW) : s.start])}
    after = {w.lower() for w in WORD.findall(text[s.end : s.end + WINDOW])}
    check, gazetteer, shape = RULES[s.kind](text[s.start : s.end], s.base)
    return (yes_no(s.base) if s.kind in KINDS else 0), check, gazetteer, 1 if (before | after) & NEAR[s.kind] else 0, -1 if before & AGAINST else 0, shape


def features(s: Span, v: tuple[int, ...]) -> np.ndarray:
    """Features of the final classifier: the votes, kind by kind, and the kind; bounded in number of distinct values."""
    kinds = KINDS + MORE_KINDS
    out = np.zeros((len(kinds), 1 + len(v)))
    out[kinds.index(s.kind)] = [1.0, *v]
    return np.concatenate([[1.0], v, out.ravel()])


N_FEATURES = 1 + len(LABELERS) + (len(KINDS) + len(MORE_KINDS)) * (1 + len(LABELERS))


class Trained(NamedTuple):
    weights: np.ndarray
    reliabilities: dict


def expectation_maximisation(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> tuple[dict, dict]:
    """patterns: (kind, votes, count). Posterior of each (kind, votes), and P(vote | class) of each labeler and kind.

    A labeler that does not abstain is right with a probability of its own for each class; PRIOR counts as so many spans beside the data."""
    posterior, model = {}, {}
    for kind in KINDS + MORE_KINDS:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        if not rows:
            continue
        v, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        weight = PRIOR_SPANS + PRIOR_SHARE * n.sum()
        prior_yes, prior_no = np.array([(PRIOR[x][0], CHECK_NO[kind] if x == "check" else PRIOR[x][1]) for x in LABELERS]).T
        loose = v[:, 0] <= 0  # candidates have a share of their own
        yes, no = prior_yes, prior_no  # P(+1 | data, not abstaining), P(-1 | none, not abstaining)
        share = np.full(len(n), 0.5)
        for _ in range(rounds):
            log = np.log(share / (1 - share)) + ((v > 0) * np.log(yes / (1 - no)) + (v < 0) * np.log((1 - yes) / no)).sum(axis=1)
            p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
            for group in (loose, ~loose):
                share[group] = np.clip(((p * n)[group].sum() + PRIOR_SPANS / 2) / (n[group].sum() + PRIOR_SPANS), 0.05, 0.95)
            hit, miss = ((p * n)[:, None] * (v > 0)).sum(axis=0), ((p * n)[:, None] * (v < 0)).sum(axis=0)
            false, right = (((1 - p) * n)[:, None] * (v > 0)).sum(axis=0), (((1 - p) * n)[:, None] * (v < 0)).sum(axis=0)
            # never worse than chance: a labeler's sign is what it says
            yes = np.clip((hit + weight * prior_yes) / (hit + miss + weight), 0.5, 0.999)
            no = np.clip((right + weight * prior_no) / (false + right + weight), 0.5, 0.999)
        model[kind] = {x: {1: (float(a), float(1 - b)), -1: (float(1 - a), float(b))} for x, a, b in zip(LABELERS, yes, no, strict=True)}
        posterior |= {(kind, tuple(int(x) for x in a)): float(b) for a, b in zip(v, p, strict=True)}
    return posterior, model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method, on soft labels."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w - np.linalg.solve(hessian, gradient)
    return w


def train(docs: DataFrame) -> Trained:
    """Reliabilities and the final classifier, from the vote patterns of all texts."""

    def run(batches):
        for batch in tv.pieces(batches):
            counts: dict[tuple, int] = {}
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                for s in base + candidates(text, base):
                    key = (s.kind, *votes(text, s))
                    counts[key] = counts.get(key, 0) + 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([list(k[1:]) for k in keys], pa.list_(pa.int32())), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "votes", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, votes array<int>, n bigint")
    # at most 5 kinds x 3^6 votes
    patterns = [(k, tuple(v), n) for k, v, n in found.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()]
    posterior, reliabilities = expectation_maximisation(patterns)
    if not patterns:
        return Trained(np.concatenate([[-1.0], [math.log(PRIOR[x][0] / (1 - PRIOR[x][0])) / 2 for x in LABELERS], np.zeros(N_FEATURES - 1 - len(LABELERS))]), {})
    x = np.stack([features(Span(k, 0, 0, True), v) for k, v, _ in patterns])
    y = np.array([posterior[k, v] for k, v, _ in patterns])
    return Trained(logistic(x, y, np.array([math.sqrt(n) for *_, n in patterns]), ridge=0.1), reliabilities)


def chosen(text: str, trained: Trained) -> list[tuple[Span, float]]:
    """All spans with their scores: the base, and candidates that the classifier takes for personal data."""
    base = base_spans(text)
    out = []
    for s in base + candidates(text, base):
        v = votes(text, s)
        score = float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(s, v) @ trained.weights))))))
        if s.base or score >= 0.5:
            out.append((s, score))
    return sorted(out, key=lambda x: ((KINDS + MORE_KINDS).index(x[0].kind), x[0].start))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint, n_secret bigint, secrets string, has_personal_data boolean, found array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"


def find(docs: DataFrame, trained: Trained | None = None) -> DataFrame:
    """Per row of docs: doc_id, base counts by kind, base_sha256, spans (of the base kinds, joined) and their number, secrets (joined) and their number, has_personal_data
    (either), found (all spans with scores)."""
    trained = trained or train(docs)
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches):
        for batch in tv.pieces(batches):
            all_spans = [chosen(t or "", trained) for t in batch.column("text").to_pylist()]
            base = [[s for s, _ in spans if s.base] for spans in all_spans]
            named, secret = ([[s for s, _ in spans if (s.kind in KINDS) == own] for spans in all_spans] for own in (True, False))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([sum(s.kind == k for s in b) for b in base], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([digest(x) for x in named], pa.string()),
                    pa.array([len(x) for x in named], pa.int64()),
                    pa.array([len(x) for x in secret], pa.int64()),
                    pa.array([digest(x) for x in secret], pa.string()),
                    pa.array([bool(x) for x in all_spans], pa.bool_()),
                    pa.array([[{"kind": s.kind, "start": s.start, "end": s.end, "base": s.base, "score": p} for s, p in spans] for spans in all_spans], found_type),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_secret", "secrets", "has_personal_data", "found"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
        else:
            at = max(at, s.end)
    return "".join([*out, text[at:]])
