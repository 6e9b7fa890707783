"""Secret scans: an Aho-Corasick automaton finds keywords, anchored expressions read on from each hit,
and checksums or encoded structure inside the match decide where a format carries them."""

from __future__ import annotations

import base64
import json
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "private_key", "slack", "stripe", "google")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_EDGE = r"(?![A-Za-z0-9_-])"
_RUN = re.compile(r"[A-Za-z0-9_-]*+")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc_tail(found: str) -> bool:
    """The last six characters are the CRC-32 of what stands between prefix and tail, in base 62."""
    body, tail = found[found.index("_") + 1 : -6], found[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, k = divmod(value, 62)
        digits = _BASE62[k] + digits
    return digits == tail


def _is_jwt(found: str) -> bool:
    """The first part decodes to a JSON object with an algorithm."""
    head = found.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


# What stands between the words of a key's body: blanks, line breaks (escaped ones too), marks of comments and strings.
_GAP = r"""(?:[\s>#*|"'`+;,/]|\\[nrt]|\\(?=[\r\n]))*+"""
_KEY_END = r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"
_MARK = re.compile(rf"{_KEY_END}|-----BEGIN\x20")
#: Six words in a row, or letters of other scripts: no key's body.
_PROSE = re.compile(r"(?<!\w)[^\W\d_]++(?:[\x20,]++[^\W\d_]++){5}(?![\w+/=])|[^\x00-\x7F]{4}")
_BODY = re.compile(
    rf"(?:{_GAP}(?:[A-Z][A-Za-z]*-[A-Z][A-Za-z]*|Comment|Version):\x20[^\r\n\\]*+)*+"  # Proc-Type: 4,ENCRYPTED
    rf"(?:(?:{_GAP}(?![a-z]++(?![A-Za-z0-9+/=]))[A-Za-z0-9+/=]{{16,}}+)++"
    rf"(?:[\x20\t\"'+;,]*+(?:\r?\n|(?:\\r)?\\n){_GAP}[A-Za-z0-9+/]{{1,15}}+={{0,2}}(?=[\x20\t\"'+;,]*+(?:[\r\n\\]|\Z)))?)?"  # a short last line
    rf"(?:{_GAP}{_KEY_END})?"
)


def _key_end(text: str, at: int) -> int:
    """Where the private key ends whose BEGIN line ends at ``at``: after its END line, or else its last base64 line.

    A BEGIN with no body and no END ends where it is. The scan stops at the next BEGIN, so all keys of a text are one pass.
    """
    mark = _MARK.search(text, at)
    if mark and not mark[0].startswith("-----BEGIN") and not _PROSE.search(text, at, mark.start()):
        return mark.end()
    body = _BODY.match(text, at).end()
    return body if text[at:body].strip() else at


# keyword in lower case -> kind, expression anchored at the keyword, test of the match
FORMATS = {
    **{f"gh{c}_": ("github", re.compile(rf"gh{c}_[A-Za-z0-9]{{36}}{_EDGE}"), _crc_tail) for c in "pousr"},
    "npm_": ("npm", re.compile(rf"npm_[A-Za-z0-9]{{36}}{_EDGE}"), _crc_tail),
    "eyj": ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]++"), _is_jwt),
    "-----begin": ("private_key", re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"), None),
    **{f"xox{c}-": ("slack", re.compile(rf"xox{c}-[0-9]{{8,}}-[A-Za-z0-9-]{{16,}}{_EDGE}"), None) for c in "abprs"},
    "sk_live_": ("stripe", re.compile(rf"sk_live_[A-Za-z0-9]{{24,}}{_EDGE}"), None),
    "aiza": ("google", re.compile(rf"AIza[A-Za-z0-9_-]{{35}}{_EDGE}"), None),
}
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, (word, "assign", ASSIGN, None))
    found.add_word("akia", ("akia", "access", ACCESS, None))
    for word, (kind, pattern, test) in FORMATS.items():
        found.add_word(word, (word, kind, pattern, test))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def spans_of(text: str, automaton=None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, ordered by start and kind; code points, end exclusive.

    Of each kind, matches are leftmost and do not overlap: a failing match is dropped and passed over.
    """
    automaton = automaton or _automaton()
    out, passed = [], {}
    hits = sorted(((end - len(word) + 1, kind, pattern, test) for end, (word, kind, pattern, test) in automaton.iter(_lower(text))), key=lambda h: h[:2])
    for start, kind, pattern, test in hits:
        if start < passed.get(kind, 0):
            continue
        if found := pattern.match(text, start):
            end = passed[kind] = _key_end(text, found.end()) if kind == "private_key" else found.end()
            if kind == "assign":
                good = len(found[1]) >= 6
            elif kind == "access":
                good = len(found[0]) >= 20
            else:
                good = test is None or test(found[0])
            if good:
                out.append((start, end, kind))
        elif kind == "jwt" and text.startswith("eyJ", start):
            passed[kind] = _RUN.match(text, start).end()  # later starts in a run are followed by the same
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))



SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, redact: str | None = None) -> DataFrame:
    """docs' columns ``keep`` (all by default) with secrets: array of (kind, start, end).

    Null and empty texts have none; repeated rows get equal spans; empty docs give no rows; columns of the new
    names are replaced. Keywords lead to every kind but hex, whose digits no keyword announces: it is looked for
    in the whole text. With ``redact``, the column ``redacted`` holds the text with every
    secret replaced by it, overlapping spans as one; null stays null.
    """

    def make():
        automaton = _automaton()

        def step(chunk, rows):
            texts = chunk.texts.to_pylist()
            found = [spans_of(t, automaton) for t in texts]
            out = {"secrets": [[{"kind": k, "start": a, "end": b} for a, b, k in f] for f in found]}
            if redact is not None:
                whole = rows.column(rows.num_columns - 1).to_pylist()
                out["redacted"] = [w if w is None else redacted(t, f, redact) for w, t, f in zip(whole, texts, found)]
            return out

        return step

    fields = [T.StructField("secrets", SPANS)] + [T.StructField("redacted", T.StringType())] * (redact is not None)
    return map_texts(docs, text_col, make, T.StructType(fields), keep)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
