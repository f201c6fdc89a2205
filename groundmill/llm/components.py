"""Connected components of links between documents or pictures."""

from __future__ import annotations

from groundmill.operators.rounds import components  # noqa: F401
