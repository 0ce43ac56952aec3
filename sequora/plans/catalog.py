"""Every query of the engine outside the training-data subpackage, with its oracle SQL."""

from __future__ import annotations

from . import addresses, archive, codecs, consensus, decode, files, kmers, libraries, models, parity, reads, relational, sequences, splits  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
