"""The queries of the text operators and their SQL, as the entry module registers them."""

from __future__ import annotations

from . import ball_kmeans, covering_lsh, filter_audit, fingerprints, language_id, mixing, neighbour_quality, ngram_lm, pii_labels, piece_codec, quality_gate, suffix_dedup, window_dedup

_MODULES = (suffix_dedup, piece_codec, pii_labels, mixing, window_dedup, fingerprints, language_id, quality_gate, covering_lsh, ngram_lm, neighbour_quality, ball_kmeans, filter_audit)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in getattr(m, "ORACLES", {}).items()}
