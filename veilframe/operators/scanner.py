"""Bytes to tokens, whole batches of texts at a time.

A text is a row of units: what a lead byte announces, cut at the text's end. In valid UTF-8 units are code points; in any
other bytes a stray continuation is a unit of its own and nothing is lost or read twice, so tokens tile every input.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD, DIGITS, SPACE, SEP, OTHER, EMAIL = range(6)
KINDS = ("word", "digits", "space", "sep", "other", "email")
_UNIT = re.compile(rb"[\x00-\xBF\xF8-\xFF]|[\xC0-\xDF].?|[\xE0-\xEF].{0,2}|[\xF0-\xF7].{0,3}", re.S)


def _table(default: int, **of: bytes) -> np.ndarray:
    t = np.full(256, default, np.int8)
    for kind, some in of.items():
        t[list(some)] = KINDS.index(kind)
    return t


_LATIN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Kind of a unit by its first byte: Latin letters, and what D0 and D1 begin, U+0400 to U+047F, are letters.
KIND = _table(OTHER, word=_LATIN + b"\xd0\xd1", digits=b"0123456789", space=b" \t\n\x0b\f\r", sep=b"-/.,")
#: Units that an e-mail address may hold on either side.
_MAIL = np.isin(np.arange(256), list(_LATIN + b"\xd0\xd1" + b"0123456789.-_+"))


def folded(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Bytes in lower case with ё as е, each letter in its place: Latin and U+0400 to U+047F. lead: where units begin."""
    out = data.copy()
    upper = lead & (data >= 65) & (data <= 90)
    out[upper] += 32
    first = np.flatnonzero(lead[:-1] & (data[:-1] >= 0xD0) & (data[:-1] <= 0xD1))
    first = first[(data[first + 1] & 0xC0) == 0x80]
    if len(first):
        code = (data[first].astype(np.int32) & 31) << 6 | data[first + 1] & 63
        low = np.where((code >= 0x410) & (code < 0x430), code + 32, code)
        low = np.where((code >= 0x400) & (code < 0x410), code + 80, low)
        low = np.where((code >= 0x460) & (code < 0x480), code | 1, low)
        low = np.where(low == 0x451, 0x435, low)
        out[first], out[first + 1] = 0xC0 | low >> 6, 0x80 | low & 63
    return out


@dataclass
class Scan:
    """Tokens of a batch of texts, in order: doc, kind, where the piece begins (at, in units; at_b, in bytes, of the batch),
    its units and bytes, and where the token begins (an e-mail's with its left side, whose words are tokens too)."""

    data: np.ndarray
    low: np.ndarray
    bounds: np.ndarray
    first_unit: np.ndarray
    valid: np.ndarray
    doc: np.ndarray
    kind: np.ndarray
    at: np.ndarray
    at_b: np.ndarray
    n: np.ndarray
    n_b: np.ndarray
    start: np.ndarray
    start_b: np.ndarray

    def strings(self, of: np.ndarray, keep: np.ndarray, where: np.ndarray | None = None) -> pa.Array:
        """The kept tokens' pieces of data or low; null where `where` says no."""
        offsets = np.append(self.at_b, len(self.data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(self.at_b), [None, pa.py_buffer(offsets), pa.py_buffer(of)])
        index = keep if where is None else pa.array(keep, mask=~where)
        pieces = pieces.take(index if where is not None else pa.array(keep))
        if self.valid.all():
            return pieces.cast(pa.string())
        return pa.array([None if p is None else p.decode(errors="replace") for p in pieces.to_pylist()], pa.string())


def scan(texts: pa.Array) -> Scan:
    """texts: Arrow binaries without nulls."""
    texts = texts.cast(pa.binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole is not None and len(texts) else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    lead, valid = (data & 0xC0) != 0x80, np.ones(len(texts), bool)
    if not lead.all() or (data >= 0xC0).any():
        for i, t in enumerate(texts.to_pylist()):
            if not t.isascii():
                try:
                    t.decode()
                except UnicodeDecodeError:
                    lo, hi = bounds[i], bounds[i + 1]
                    valid[i], lead[lo:hi] = False, False
                    lead[lo + np.array([m.start() for m in _UNIT.finditer(t)])] = True
    unit = np.flatnonzero(lead)
    first_unit = np.searchsorted(unit, bounds)
    byte = data[unit]
    cls = KIND[byte]
    begins = np.ones(len(unit), bool)
    begins[1:] = (cls[1:] > SPACE) | (cls[1:] != cls[:-1])
    begins[first_unit[:-1][first_unit[:-1] < len(unit)]] = True
    left = {}
    at_signs = np.flatnonzero(byte == 0x40)
    if len(at_signs):
        mail = _MAIL[byte]
        no_mail = np.flatnonzero(~mail)
        doc_of = np.searchsorted(first_unit, at_signs, "right") - 1
        for k, d in zip(at_signs.tolist(), doc_of.tolist()):
            lo, hi = int(first_unit[d]), int(first_unit[d + 1])
            j = int(np.searchsorted(no_mail, k))  # no_mail[j] is k itself
            right = min(hi, int(no_mail[j + 1])) if j + 1 < len(no_mail) else hi
            start = max(lo, int(no_mail[j - 1]) + 1) if j else lo
            if start < k and right > k + 1:
                left[k] = start
                begins[k + 1 : right] = False
                if right < len(unit):
                    begins[right] = True
    at = np.flatnonzero(begins)
    kind = cls[at].copy()
    at_b = unit[at]
    start, start_b = at.copy(), at_b.copy()
    if left:
        rows = np.searchsorted(at, list(left))
        kind[rows], start[rows], start_b[rows] = EMAIL, list(left.values()), unit[list(left.values())]
    ends, ends_b = np.append(at[1:], len(unit)), np.append(at_b[1:], len(data))
    doc = np.searchsorted(bounds, at_b, "right") - 1
    return Scan(data, folded(data, lead), bounds, first_unit, valid, doc, kind, at, at_b, ends - at, ends_b - at_b, start, start_b)
