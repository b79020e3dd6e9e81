"""Plain versions that several tests share."""

from __future__ import annotations

from test_disclosure import brute_base as brute_spans  # noqa: F401
from test_simhash import brute_components, brute_print  # noqa: F401
