"""Settings of ranking, crawling and retrieval; every time-dependent operator takes ``as_of`` instead of the clock."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone


@dataclass(frozen=True)
class EngineConfig:
    # vectors and fusion
    vector_topk: int = 100
    rrf_k: int = 60
    vector_pull: int = 25
    embedding_dim: int = 64
    uniform_eps: float = 1e-4
    # ranking
    search_cap: int = 60
    federated_cap: int = 18
    page_size: int = 10
    page_size_max: int = 20
    node_cap: int = 3
    junk_ratio: float = 0.20
    junk_penalty: float = 0.85
    click_weight: float = 0.3
    inbound_weight: float = 0.2
    # suggestion
    min_similarity: float = 0.42
    min_document_frequency: int = 2
    # crawling
    recrawl_hours: int = 24
    max_attempts: int = 4
    lease_seconds: int = 75
    seed_nodes: frozenset[str] = field(default_factory=frozenset)
    # request rate
    rate_per_second: float = 2.0
    rate_burst: float = 6.0
    idle_seconds: int = 300


DEFAULT = EngineConfig()
#: The instant that the test tables are looked at from: after the last fetch, and after the last view.
AS_OF = datetime(2025, 7, 1, tzinfo=timezone.utc)
EVENTS_AS_OF = datetime(2025, 1, 20, tzinfo=timezone.utc)
