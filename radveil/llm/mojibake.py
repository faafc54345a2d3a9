"""Text decoded with the wrong character encoding: detection and repair.

Every word with a character beyond ASCII or an escape is the start of a best-first search. Edges are decoding
repairs (map the characters back to the bytes of a wrong encoding and read these as UTF-8, or as
another single-byte encoding) and unescaping. States are hashed, so none is visited twice; the queue is
ordered by a plausibility cost of the characters, and the cheapest text reached is the repair, if no other text is as
cheap: with two or more the word is named as damaged but stays. The search ends when the queue is empty: a
step shortens the word, or leaves nothing for a second step of its kind. No row leaves its partition: there is no shuffle.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings under which UTF-8 bytes are read by mistake, the usual ones first; undefined bytes pass as C1 controls.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "cp866", "mac_roman")
#: Single-byte encodings read as one another: (wrong, right).
SWAPS = (("cp1251", "cp1252"), ("cp1253", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp866", "cp1251"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("koi8_r", "cp1251"))
WORD = re.compile(r"[^ \t\r\n|]+")
RUN = re.compile(r"[^\x00-\x7f]+")
ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});|\\u[0-9a-fA-F]{4}")
UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def _table(name: str) -> dict[str, int]:
    to_byte = {}
    for b in range(256):
        try:
            to_byte[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            to_byte.setdefault(chr(b), b)
    return to_byte


TO_BYTE = {n: _table(n) for n in {*WRONG, *(a for a, _ in SWAPS)}}


@lru_cache(maxsize=20_000)
def _kind(ch: str) -> tuple[str, str]:
    """(script or class, general category)."""
    cat = unicodedata.category(ch)
    if cat[0] in "LM":
        name = unicodedata.name(ch, "")
        script = name.split(" ")[0] if name else "?"
        return ("COMMON" if ch in "µªº" or script in ("COMBINING", "MODIFIER") else script), cat
    return "COMMON", cat


def script_of(ch: str) -> str:
    return _kind(ch)[0]


def penalty(word: str, scripts: frozenset[str]) -> float:
    """Implausibility of a word's characters; ``scripts``: those that whole words of the field are written in."""
    total, prev = 0.0, ""
    letters = [c for c in word if c.isalpha()]
    for k, ch in enumerate(word):
        script, cat = _kind(ch) if ord(ch) > 127 else ("LATIN" if ch.isalpha() else "COMMON", "")
        before = script_of(prev) if prev and prev.isalpha() else ""
        after = word[k + 1 : k + 2]
        if ord(ch) > 127:
            if cat == "Cc":
                total += 8
            elif ch == "�":
                total += 8
            elif cat in ("Co", "Cn", "Cs"):
                total += 8
            elif cat == "So" and ch not in "°©®™№":
                total += 5
            elif cat in ("Sk", "Lm") and ch not in "ᵉʳʰⁿᵗˢᵈᵃᵒ":
                total += 3
            elif cat in ("Sm", "Sc", "Po", "Ps", "Pi", "Pf", "No", "Cf") and before and after.isalpha() and ch not in "’·‐‑‌‍­–—":
                total += 3
            elif cat in ("No", "Sc") and not before and after.isalpha() and ch not in "½¼¾":
                total += 3
            elif ch in "‚„†‡" and before:
                total += 3
        if ch.isalpha() and before and script not in ("COMMON",) and before not in ("COMMON",) and script != before:
            # a Greek letter may lead a Latin one (a quantity), no other mix is usual
            total += 0 if before == "GREEK" else 6
        if ord(ch) > 127 and cat == "Lu" and prev.islower():
            total += 4
        prev = ch
    rare = {s for c in letters if (s := script_of(c)) not in ("LATIN", "COMMON", "GREEK")} - scripts
    if rare & {"CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "THAI"} and len(letters) <= 2:
        total += 5
    return total


def cost(word: str, scripts: frozenset[str]) -> float:
    """Characters beyond ASCII cost, Latin letters of no usual alphabet more, escapes of such characters most."""
    rare = sum(0x17F < ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1EA0 for c in word)
    return penalty(word, scripts) + sum(ord(c) > 127 for c in word) + 0.5 * rare + 2 * sum(_unescaped(m[0]) != m[0] for m in ENTITY.finditer(word))


def _utf8_under(word: str, wrong: str) -> str:
    """The word with each valid UTF-8 sequence, seen through the wrong encoding, read as UTF-8."""
    table = TO_BYTE[wrong]

    def fix(m: re.Match) -> str:
        run = m[0]
        raw = bytes(table.get(c, 0x20) for c in run)
        out, at = [], 0
        for s in UTF8.finditer(raw):
            out += [run[at : s.start()], s[0].decode("utf-8")]
            at = s.end()
        return "".join(out) + run[at:] if out else run

    return RUN.sub(fix, word)


def _swapped(word: str, wrong: str, right: str) -> str | None:
    table = TO_BYTE[wrong]
    try:
        return RUN.sub(lambda m: bytes(table[c] for c in m[0]).decode(right), word)
    except (KeyError, UnicodeDecodeError):
        return None


def _unescaped(word: str) -> str:
    """The word with its escapes of characters beyond ASCII undone; &amp; and the like are no damage."""

    def plain(m: re.Match) -> str:
        ch = chr(int(m[0][2:], 16)) if m[0][0] == "\\" else html.unescape(m[0])
        return m[0] if ch.isascii() else ch

    return ENTITY.sub(plain, word)


USUAL = "£§°±²³·¼½¾×÷€–—‘’“”«»…"  # signs that stand in ordinary text
PRIOR = 0.001  # per place in WRONG: of texts that are equally plausible the one by the more usual mistake is cheaper


def _readings(word: str, scripts: frozenset[str]) -> list[str]:
    """Other readings of an implausible word's bytes. That proves nothing by itself: they must leave nothing implausible."""
    if penalty(word, scripts) < 3:
        return []
    every = (_swapped(word, wrong, right) for wrong, right in SWAPS)
    return [nxt for nxt in every if nxt and nxt != word and penalty(nxt, scripts) == 0]


def _steps(word: str, scripts: frozenset[str]):
    """(next word, is it a decoding step, what the step costs). Another reading as a single-byte encoding has no usual order, so
    two of these that leave nothing implausible stay a tie."""
    for k, wrong in enumerate(WRONG):
        nxt = _utf8_under(word, wrong)
        if nxt != word:
            yield nxt, True, PRIOR * k
    for nxt in _readings(word, scripts):
        # a letter that becomes an unusual sign is no repair
        if all(b.isalpha() or b in USUAL or not a.isalpha() for a, b in zip(word, nxt)):
            yield nxt, True, PRIOR
    if ENTITY.search(word):
        nxt = _unescaped(word)
        if nxt != word:
            yield nxt, False, 0.0


@lru_cache(maxsize=200_000)
def repair(word: str, scripts: frozenset[str] = frozenset()) -> tuple[str, bool]:
    """(cheapest text reached, whether characters come from a wrong decoding, restorable or not)."""
    queue, seen = [(cost(word, scripts), 0, word, False, 0.0)], {word}
    least, cheapest = queue[0][:2], [(word, False)]
    while queue:
        c, depth, state, decoded, paid = heapq.heappop(queue)
        if (c, depth) < least:
            least, cheapest = (c, depth), []
        if (c, depth) == least and depth:
            cheapest.append((state, decoded))
        for nxt, is_decoding, price in _steps(state, scripts):
            if nxt not in seen:
                seen.add(nxt)
                heapq.heappush(queue, (cost(nxt, scripts) + paid + price, depth + 1, nxt, decoded or is_decoding, paid + price))
    decoded = any(d for _, d in cheapest)
    fixed = cheapest[0][0] if decoded and len(cheapest) == 1 else word
    # another reading that would make the word plausible shows that it is damaged, even if it isn't taken
    return fixed, decoded or bool(_readings(word, scripts)) or any(ch == "�" or 0x80 <= ord(ch) < 0xA0 and ch != "\x85" for ch in word)


def scripts_in(text: str) -> frozenset[str]:
    """Scripts in which the text has a whole word of three letters or more."""
    out = set()
    for w in re.findall(r"[^\W\d_]{3,}", text):
        if not w.isascii():
            found = {script_of(c) for c in w} - {"COMMON"}
            if len(found) == 1:
                out |= found
    return frozenset(out)


def repair_text(text: str | None) -> tuple[str | None, bool]:
    """(restored text, hit). Null, empty and ASCII texts without escapes stay and are no hit; an escape is only undone
    where a wrong decoding stands behind it."""
    if not text or text.isascii() and not ENTITY.search(text):
        return text, False
    scripts, hit = scripts_in(text), False

    def fix(m: re.Match) -> str:
        nonlocal hit
        if m[0].isascii() and not ENTITY.search(m[0]):
            return m[0]
        got, bad = repair(m[0], scripts)
        hit = hit or bad
        return got

    return WORD.sub(fix, text), hit


_ONE = T.StructType([T.StructField("fixed", T.StringType()), T.StructField("hit", T.BooleanType())])
_MANY = T.StructType([T.StructField("fixed", T.ArrayType(T.StringType())), T.StructField("hit", T.BooleanType())])


@F.pandas_udf(_ONE)
def _repair_column(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair_text(t) for t in texts], columns=["fixed", "hit"])


@F.pandas_udf(_MANY)
def _repair_values(values: pd.Series) -> pd.DataFrame:
    rows = [[] if v is None else [repair_text(x) for x in v] for v in values]
    return pd.DataFrame({"fixed": [[x for x, _ in r] for r in rows], "hit": [any(h for _, h in r) for r in rows]})


def restored(files: DataFrame) -> DataFrame:
    """(file_index, text, meta, text_hit, meta_hit) with text and metadata values as written, as far as nothing was lost.

    Null text and null, empty or partial maps stay as they are and are no hit. Map keys aren't touched. Other columns of the
    input don't matter, whatever their names.
    """
    got = files.select("file_index", F.col("meta").alias("__meta"), _repair_column("text").alias("__t"), _repair_values(F.map_values("meta")).alias("__m"))
    meta = F.when(F.col("__meta").isNotNull(), F.map_from_arrays(F.map_keys("__meta"), F.col("__m.fixed")))
    return got.select("file_index", F.col("__t.fixed").alias("text"), meta.alias("meta"), F.col("__t.hit").alias("text_hit"), F.col("__m.hit").alias("meta_hit"))


def found(files: DataFrame) -> DataFrame:
    """(file_index, field): a row for each file and field with characters from a wrong decoding. Repeated rows count once."""
    got = files.select("file_index", F.array(F.when(_repair_column("text")["hit"], "text"), F.when(_repair_values(F.map_values("meta"))["hit"], "meta")).alias("f"))
    return got.select("file_index", F.explode(F.array_compact("f")).alias("field")).distinct()


