"""Secret scans: strings in sensitive places that zstandard, primed with dictionaries, finds new."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import map_arrow
from . import textvec

#: Parts of names that make what is assigned to them sensitive.  They set how much novelty is asked for; what is measured doesn't depend on them.
KEYWORDS = ("token", "secret", "passw", "pwd", "api_key", "apikey", "api-key", "access_key", "accesskey", "access-key", "private key", "private_key", "authorization", "credential")
SENSITIVE = re.compile(r"(?i)token|secret|passw|passphrase|pwd|credential|authoriz|bearer|api[_\- ]?key|(?:^|[_\-. a-z])(?:key|auth|pass|salt|sig|signature)s?$")
#: Names that also say other things; their values must be longer.
WEAK = re.compile(r"(?i)(?:^|[_\-. a-z])(?:key|auth|pass|salt|sig|signature)s?$")
WEAK_LENGTH = 12
#: What a value starts with that only refers to one kept elsewhere.
REFERENCE = ("$", "{{", "<", "%(", "%{", "#{", "@")
#: Shortest value looked at, and the length from which a value in one kind of characters is.
SHORTEST = 8
LEAST_LENGTH = 16
#: A value in a sensitive place is reported if it adds at least so many bytes, and so many a character.
NOVEL_BYTES = 8
NOVEL_RATIO = 0.4
#: A long value in one kind of characters has to add more bytes.
PLAIN_BYTES = 14
#: The same for values of other names, quoted or not, and for key material without a name: these have to mix digits, small and capital letters.
KEY_LENGTH = 20
KEY_RATIO = 0.6
BARE_LENGTH = 24
BARE_RATIO = 0.7
#: Characters of surrounding text on each side: the code near a value, not the document.
AROUND = 1000
#: Identifiers are words that at least so many documents have, and such a share of all, by which their number is bounded at any size of corpus.
LEAST_DOCUMENTS = 3
LEAST_SHARE = 1e-5
#: Min-hashes by which copies of a document are told from other documents.
COPY_KEYS = 4
MASK = "[secret]"
CODE = " ".join(
    """if else for while return import from class def function const let var public private static void string int true false none null new this self
    your_api_key_here your_token_here your_secret_here my_secret_token change_me changeme placeholder example_token example_secret test_token dummy_token
    insert_token_here replace_with_your_token access_token refresh_token secret_key api_key password username client_id client_secret authorization bearer
    xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 0000000000000000000000000000000000 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0123456789abcdef
    os.environ process.env getenv config settings https:// http:// localhost""".split()
)

ASSIGNED = re.compile(
    r"(?i)(" + "|".join(map(re.escape, KEYWORDS)) + r""")[\w.\-]{0,40}["']?[ \t]{0,4}(?:=>|[:=]{1,2})[ \t]{0,4}["'`]?(?:bearer[ \t]{1,4})?([A-Za-z0-9+/_=.~\-]{%d,})""" % LEAST_LENGTH
)
PEM = re.compile(r"-----BEGIN [A-Z ]{0,30}(PRIVATE KEY)-----\s*([A-Za-z0-9+/=\s]{%d,}?)\s*-----END" % LEAST_LENGTH)


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), 95]] = True
LONG = re.compile(r"\b[A-Za-z_]{%d,}\b" % LEAST_LENGTH)
NAMES = re.compile(r"\b[A-Za-z_]{3,}\b")
UNSURE = re.compile(f"{ASSIGNED.pattern[4:]}|{PEM.pattern}", re.I)


def long_runs(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows that have a run of LEAST_LENGTH or more letters and underscores."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = LETTER[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    return np.unique(np.searchsorted(offsets, start[size >= LEAST_LENGTH], side="right") - 1)


def corpus_identifiers(docs: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE) -> list[str]:
    """Words of LEAST_LENGTH or more letters and underscores that enough documents have, the most frequent first.

    All documents are counted, but not what is assigned to a keyword: a value
    found nowhere else can't be told from a secret that was pasted often.  Words
    with digits don't count, nor do shorter ones: with prose words primed, short
    secrets cost fewer bytes and are missed.  Documents with equal min-hashes
    count once, by the min-hash that leaves the fewest but one, as a single one may
    be of a word that all have; so copies of one document don't make its secret
    an identifier.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.blocks(batch):
                out: tuple[list[str], list[int], list[int]] = ([], [], [])
                column = part.column(0)
                for i in long_runs(*textvec.buffers(column)).tolist():
                    text = column[i].as_py() or ""
                    if any(k in text.lower() for k in KEYWORDS):
                        text = UNSURE.sub(" ", text)
                    found = set(LONG.findall(text))
                    if found:
                        words = set(NAMES.findall(text))
                        for k in range(COPY_KEYS):
                            key = min(xxhash.xxh64_intdigest(w, seed=k) for w in words) >> 1
                            for w in found:
                                out[0].append(w), out[1].append(k), out[2].append(key)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["w", "k", "key"])

    each = map_arrow(docs.select("text"), run, "w string, k int, key bigint")
    each = each.distinct().groupBy("w", "k").agg(F.count("*").alias("n")).groupBy("w").agg(F.element_at(F.array_sort(F.collect_list("n")), 2).alias("n"))
    rows = each.where(F.col("n") >= max(least, math.ceil(share * docs.count()))).collect()  # bounded by ``share``
    return [r["w"] for r in sorted(rows, key=lambda r: (-r["n"], r["w"]))]


class Novelty:
    """Marginal compressed bytes of a string in its surroundings, with the dictionary known beforehand."""

    def __init__(self, identifiers: list[str]):
        primed = (CODE + " " + " ".join(reversed(identifiers))).encode()  # the most frequent come last, where they are cheapest
        known = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=6)
        self.compressor = zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False)

    def bytes(self, candidate: str, before: str, after: str) -> int:
        known = (before.replace(candidate, " ") + "\n" + after.replace(candidate, " ") + "\n").encode("utf-8", "replace")
        return max(0, len(self.compressor.compress(known + candidate.encode("utf-8", "replace"))) - len(self.compressor.compress(known)))


SIGN = re.compile(r"=>|:=|[:=]")
NAME = re.compile(r"""([\w.\-]{1,60}|[A-Za-z]{2,20} [A-Za-z]{2,20})["'`\]]{0,2}\s{0,12}$""")
OPENING = re.compile(r"""=?\s{0,40}[\[({]{0,3}\s{0,40}(?:(?i:bearer|basic|token)\s{1,4})?""")
QUOTED = {q: re.compile(rf"[^{q}\n]{{0,4096}}") for q in "\"'`"}
VALUE = re.compile(r"""[^\s"'`,;<>(){}\[\]|]+""")
USERINFO = re.compile(r"""://[^\s/?#@:"'<>]{0,100}:([^\s/@"'<>]{4,200})@[\w.\-]""")
TAG = re.compile(r"<([A-Za-z][\w.\-]{1,60})(?:\s[^<>]{0,200})?>([^<>\n]{4,4096})</\1\s*>")
BEARER = re.compile(r"(?i)\b(bearer)[ \t]{1,4}([A-Za-z0-9+/_=.~\-]{%d,})" % KEY_LENGTH)
BARE = re.compile(r"(?<![A-Za-z0-9+/_=\-])[A-Za-z0-9+/_=\-]{%d,}" % BARE_LENGTH)


def classes(value: str) -> tuple[bool, bool, bool, bool]:
    """(digit, small letter, capital after the first character, other mark than - _ . ,) in the value."""
    return any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value[1:]), any(not c.isalnum() and c not in "-_.,' " for c in value)


def mixed(value: str) -> bool:
    digit, small, capital, mark = classes(value)
    return digit + small + capital + mark >= 2


def key_like(value: str) -> bool:
    """Digits, small and capital letters, several of each, and no path or sentence."""
    return sum(c.isdigit() for c in value) >= 3 and sum(c.islower() for c in value) >= 3 and sum(c.isupper() for c in value) >= 3 and " " not in value and "://" not in value and value.count("/") < 0.1 * len(value) and value.count(".") < 4


def sensitivity(name: str) -> str | None:
    """What makes a name that of a secret."""
    m = SENSITIVE.search(name)
    return m.group().strip(" _-.").lower() if m else None


def wanted(value: str, name: str, sensitive: bool) -> tuple[int, float] | None:
    """(bytes, bytes a character) that the value must add to be a secret; None if it can't be one."""
    if value.startswith(REFERENCE):
        return None
    if sensitive and WEAK.search(name) and not SENSITIVE.search(WEAK.sub("", name)) and len(value) < WEAK_LENGTH:
        return None
    if sensitive and SHORTEST <= len(value) and " " not in value.strip():
        if mixed(value):
            return NOVEL_BYTES, NOVEL_RATIO
        return (PLAIN_BYTES, NOVEL_RATIO) if len(value) >= LEAST_LENGTH else None
    if len(value) >= KEY_LENGTH and key_like(value):
        return PLAIN_BYTES, KEY_RATIO
    return None


def candidates(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, name, sensitive place) of every value in the text: assigned to any name, in a tag, in a URL, a private key, or key material by itself."""
    for m in PEM.finditer(text):
        yield *m.span(2), "private key", True
    for m in USERINFO.finditer(text):
        yield *m.span(1), "url", True
    for m in BEARER.finditer(text):
        yield *m.span(2), "bearer", True
    if "</" in text:
        for m in TAG.finditer(text):
            yield *m.span(2), m.group(1), bool(SENSITIVE.search(m.group(1)))
    for m in SIGN.finditer(text):
        at = m.end()
        if text.startswith("//", at):
            continue
        name = NAME.search(text, max(0, m.start() - 80), m.start())
        if name is None:
            continue
        a = OPENING.match(text, at).end()
        quote = text[a : a + 1]
        if quote in QUOTED and quote:
            a += 1
            b = QUOTED[quote].match(text, a).end()
        else:
            v = VALUE.match(text, a)
            if v is None:
                continue
            b = v.end()
            while b > a and text[b - 1] in ".:!?":
                b -= 1
        yield a, b, name.group(1), bool(SENSITIVE.search(name.group(1)))
    for m in BARE.finditer(text):
        yield *m.span(), "", False


def scan(text: str, novelty: Novelty) -> list[tuple[int, int, str, int]]:
    """(start, length, name, novel bytes) of each secret, in order, none overlapping."""
    found: list[tuple[int, int, str, int]] = []
    # Of overlapping values one in a sensitive place comes first, then the longest.
    for a, b, name, sensitive in sorted(candidates(text), key=lambda c: (not c[3], c[0] - c[1], c[0])):
        value = text[a:b]
        need = wanted(value, name, sensitive)
        if need is None or (not name and not (len(value) >= BARE_LENGTH and key_like(value) and not text.endswith("base64,", 0, a))):
            continue
        if any(a < at + n and at < b for at, n, *_ in found):
            continue
        new = novelty.bytes(value, text[max(0, a - AROUND) : a], text[b : b + AROUND])
        if new >= need[0] and new >= (need[1] if name else BARE_RATIO) * len(value):
            found.append((a, b - a, sensitivity(name) or name.lower() or "key", new))
    return sorted(found)


def find_secrets(docs: DataFrame, identifiers: list[str] | None = None) -> DataFrame:
    """(doc_id, start, n_chars, keyword, novel_bytes) of every secret found.

    Every text is read, and every value in it is a candidate: what is assigned
    to any name, quoted or not, the content of tags, passwords in URLs, bearer
    tokens, bodies of private keys, and key material by itself.  Each is
    measured: the bytes by which zstandard's output grows when it is appended to
    the AROUND characters on its both sides, from which the value itself is
    taken out, after priming with a dictionary of code words, placeholders and
    the corpus's own identifiers.  How sensitive the place is says how much is
    needed: NOVEL_BYTES where the name is that of a secret, more for values of
    other names or none, which have to mix digits, small and capital letters, so
    that digests and ids in prose aren't reported.  Placeholders and known names
    compress away; what stays incompressible is reported, never the string itself.

    Defined cases: null and empty texts have none; a secret written several
    times is reported each time; repeated rows are reported each; null doc_ids
    are reported as null; very long texts are searched whole; ``start`` counts
    characters from 0; other columns are ignored; an empty table gives no rows.
    """
    names = corpus_identifiers(docs) if identifiers is None else identifiers
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(names)
        for batch in batches:
            which, hits = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = scan(text, novelty) if text else []
                which += [i] * len(got)
                hits += got
            cols = list(zip(*hits, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "start", "n_chars", "keyword", "novel_bytes"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {doc_type}, start bigint, n_chars bigint, keyword string, novel_bytes bigint")


def redact_secrets(docs: DataFrame, identifiers: list[str] | None = None, mask: str = MASK) -> DataFrame:
    """``docs`` with each secret replaced by ``mask`` and ``n_chars``, if there, made to match; every document stays.

    Blocks without a secret pass through unchanged.  Cases are those of find_secrets.
    """
    names = corpus_identifiers(docs) if identifiers is None else identifiers
    schema = docs.schema
    columns = schema.fieldNames()
    at = columns.index("text")
    sizes = [i for i, c in enumerate(columns) if c == "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(names)
        for batch in batches:
            for part in textvec.blocks(batch, batch.schema.names[at]):
                arrays, texts, lengths = list(part.columns), part.column(at).to_pylist(), {}
                for i, text in enumerate(texts):
                    hits = scan(text, novelty) if text else []
                    for start, size, _, _ in reversed(hits):
                        text = text[:start] + mask + text[start + size :]
                    if hits:
                        texts[i], lengths[i] = text, len(text)
                if not lengths:
                    yield part
                    continue
                arrays[at] = pa.array(texts, arrays[at].type)
                for c in sizes:
                    arrays[c] = pa.array([lengths.get(i, v) for i, v in enumerate(arrays[c].to_pylist())], arrays[c].type)
                yield pa.RecordBatch.from_arrays(arrays, part.schema.names)

    # Spark's own schema: nullability and nested types stay as they are.
    return map_arrow(docs, run, schema)
