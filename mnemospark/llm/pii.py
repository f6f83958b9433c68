"""Personal data by anchor expansion.

Operator 2.  One Aho-Corasick pass over a text finds its anchors: at-signs, plus
signs, digits, URL schemes and the cue words of identifiers.  From each anchor a
small deterministic parser expands to the borders of what it announces and
validates it.  All parsers are linear in the text: the runs that they read stop
at the next anchor of their kind.

Base kinds are email, ip, card and phone.  Added kinds are url_user (a user name
and password in a URL), hidden_email (name (at) host (dot) tld), iban (ISO 7064
check), ssn and account (an identifier after its cue).
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from mnemospark.llm._spans import Span, scan

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url_user", "hidden_email", "iban", "ssn", "account")
ACCOUNT_CUES = ("account", "acct", "passport", "routing", "tax id", "customer id", "license no", "konto", "compte", "cuenta")
CUES = {"@": "at", "+": "plus", "://": "scheme", "(at)": "hidden", "[at]": "hidden", " at ": "hidden", "iban": "iban", "ssn": "ssn", "social security": "ssn"}
#: An identifier stands so many characters after its cue, at most.
REACH = 24

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USERINFO = re.compile(r"://[A-Za-z0-9._~%!$&'()*+,;=-]+:[^\x20\x09-\x0D@/]+@[A-Za-z0-9.-]+")
HIDDEN = re.compile(r"(?: at | ?[(\[]at[)\]] ?)[A-Za-z0-9-]+(?:(?: dot | ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)+", re.I)
IBAN = re.compile(r"[^A-Za-z0-9]{1,8}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
SSN = re.compile(r"[^0-9]{1,24}?((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])")
ACCOUNT = re.compile(r"(?:[ .:#=-]|number|num|no|nr)*[:# =]([A-Z]{0,3}[0-9][0-9-]{4,16}[0-9])(?![A-Za-z0-9])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in [*CUES.items(), *((w, "account") for w in ACCOUNT_CUES), *((str(d), "digit") for d in range(10))]:
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def find(raw: bytes, anchors: ahocorasick.Automaton) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text, in bytes."""
    base: list[Span] = []
    added: list[Span] = []
    s = ""
    done = {"at": 0, "card": 0, "plus": 0}
    runs: list[tuple[int, int]] = []  # of digits
    run_end = 0
    for last, (kind, n) in anchors.iter(raw.lower().decode("latin-1")):
        s = s or raw.decode("latin-1")
        at = last + 1 - n
        if kind == "digit":
            if at >= run_end:
                run_end = DIGITS.match(s, at).end()
                runs.append((at, run_end))
                if at >= done["card"] and (m := CARD.match(s, at)):
                    done["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        base.append((m.start(), 2, m.end()))
        elif kind == "at":
            lo = at
            while lo > done["at"] and s[lo - 1] in LOCAL:
                lo -= 1
            if lo < at and (m := DOMAIN.match(s, at + 1)):
                base.append((lo, 0, m.end()))
                done["at"] = m.end()
        elif kind == "plus":
            if m := PHONE.match(s, at):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    base.append((at, 3, m.end()))
        elif kind == "scheme":
            if m := USERINFO.match(s, at):
                lo = at
                while lo > 0 and s[lo - 1].isascii() and s[lo - 1].isalpha():
                    lo -= 1
                added.append((lo, 4, m.end()))
        elif kind == "hidden":
            lo = at - (at > 0 and s[at - 1] == " " and s[at] != " ")
            if m := HIDDEN.match(s, lo):
                left = lo
                while left > 0 and s[left - 1] in LOCAL:
                    left -= 1
                if left < lo:
                    added.append((left, 5, m.end()))
        elif kind == "iban":
            if (m := IBAN.match(s, last + 1)) and iban_valid(m.group(1)):
                added.append((m.start(1), 6, m.end(1)))
        elif kind == "ssn":
            if m := SSN.match(s, last + 1):
                added.append((m.start(1), 7, m.end(1)))
        elif (m := ACCOUNT.match(s, last + 1, last + 1 + REACH + 20)) and m.start(1) - last <= REACH:
            added.append((m.start(1), 8, m.end(1)))
    # Addresses: four digit runs with a single dot between each.
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(four[j][1] + 1 == four[j + 1][0] and s[four[j][1]] == "." for j in range(3)):
            if all(b - a <= 3 and int(s[a:b]) <= 255 or not s[a:b].lstrip("0")[3:] and int(s[a:b].lstrip("0") or "0") <= 255 for a, b in four):
                base.append((four[0][0], 1, four[3][1]))
            i += 4
        else:
            i += 1
    return base, added


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row.

    A null text counts as empty and has no spans; a null id is passed on; repeated
    rows give repeated results; other columns are ignored.
    """

    def finder():
        anchors = automaton()
        return lambda raw: find(raw, anchors)

    return scan(docs, finder, KINDS, BASE, id_col, text_col)


def op2(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
