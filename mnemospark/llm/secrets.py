"""Secret scan by token efficiency.

Operator 6.  Base kinds (assign, access, hex) are patterns.  The method adds
``random``: a run of key characters that a public BPE vocabulary can only spell in
short pieces.  Text that people write reuses the vocabulary's long tokens; a random
string has few characters a token.  Digests of known length, UUIDs, plain numbers
and dotted or dashed names of words are excluded before the test.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame

from mnemospark.llm._spans import Span, scan

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
#: The vocabulary, in tiktoken's format; the driver reads it and broadcasts its bytes, MOST_VOCABULARY at most.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY = 16 << 20
#: Runs with fewer characters a token than this are random.
MOST_CHARS_A_TOKEN = 2.2
LEAST_LENGTH = 20

WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST_LENGTH)
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z", re.I)
NUMBER = re.compile(r"[0-9+/_=-]+\Z")
#: Each part can be read in one way only, and none is given back: time is linear in the run.
NAMES = re.compile(r"(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+)(?:[/_=+-]++(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+))*+\Z")
#: Verdicts on runs of so many characters at most are kept, CACHED of them.
CACHED_LENGTH, CACHED = 256, 1 << 15
#: A candidate mixes at least two of these.
CLASSES = (re.compile(r"[0-9]"), re.compile(r"[a-z]"), re.compile(r"(?!^)[A-Z]"))


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Digests, UUIDs, numbers and names made of words: no secrets by themselves."""
    return bool(NUMBER.match(run) or NAMES.match(run) or DIGEST.match(run) or UUID.match(run))


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MOST_VOCABULARY + 1)
    if len(raw) > MOST_VOCABULARY:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY} bytes")
    return raw


def randomness(vocabulary: bytes, most: float = MOST_CHARS_A_TOKEN) -> Callable[[str], bool]:
    """Whether a run of key characters is a random string."""
    encoder = _encoder(vocabulary)

    def test(run: str) -> bool:
        if known(run) or sum(bool(c.search(run)) for c in CLASSES) < 2:
            return False
        return len(run) < most * len(encoder.encode_ordinary(run))

    short = lru_cache(maxsize=CACHED)(test)
    return lambda run: short(run) if len(run) <= CACHED_LENGTH else test(run)


def find(raw: bytes, is_random: Callable[[str], bool]) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text, in bytes."""
    base: list[Span] = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    added = [(m.start(), 3, m.end()) for m in RUN.finditer(raw) if is_random(m.group().decode())]
    return base, added


def secrets(docs: DataFrame, vocabulary: str = VOCABULARY, most_chars_a_token: float = MOST_CHARS_A_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row.

    A null text counts as empty and has no spans; a null id is passed on; repeated
    rows give repeated results; other columns are ignored.  Names are matched in
    ASCII letters of either case.
    """
    words = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # MOST_VOCABULARY bytes at most

    def finder():
        is_random = randomness(words.value, most_chars_a_token)
        return lambda raw: find(raw, is_random)

    return scan(docs, finder, KINDS, BASE, id_col, text_col)


def op6(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
