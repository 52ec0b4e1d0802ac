"""Tables, parameters and versions.

perm(seq_id, i, pi) · runs(seq_id, interval, start, length, image) · move: runs with pointer and off ·
rlbwt(seq_id, run, ch, length) · bwt(seq_id, i, ch) · cursors(seq_id, interval, off[, idx]) · all numbers are BIGINT.
Any further columns of an interval table are its payload.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Version of the stored tables.
VERSION = 1
#: End mark of a text in a BWT; it sorts before every other symbol.
TERMINATOR = chr(1)
KEY = "seq_id"


@dataclass(frozen=True)
class SplitParams:
    """How to split long intervals: by a factor of the mean length, by a balancing factor, or not (None)."""

    length_capping: float | None = 8.0
    balancing: int | None = 16


UNSPLIT = SplitParams(None, None)
USUAL = SplitParams()
CAPPED = SplitParams(8.0, None)
BALANCED = SplitParams(None, 16)
