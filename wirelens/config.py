"""Every knob of the engine, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000_000
MILLI = 1_000_000


@dataclass(frozen=True)
class EngineConfig:
    pair_ttl_ns: int = 60 * SECOND
    window_ns: int = 60 * SECOND
    max_edges: int = 4096
    max_series: int = 2048
    # Upper bounds of the latency buckets, in ms.
    latency_bounds_ms: tuple[int, ...] = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)
    message_cap: int = 8192
    prefix_bytes: int = 256
    join_window_ns: int = 5 * MILLI
    wire_slack_ns: int = 20 * MILLI
    times_per_direction: int = 4096
    span_queue: int = 1024
    trace_sample: int = 10
    profile_ttl_ns: int = 2 * SECOND
    profile_min_ns: int = 20 * MILLI
    profile_top: int = 5
    peer_ttl_ns: int = 120 * SECOND
    sample_n_max: int = 16
    sample_decay_ticks: int = 30
    h2_conns: int = 8192
    h2_streams: int = 2048
    # Request paths of streamed model calls.
    llm_paths: tuple[str, ...] = ("/v1/messages", "/v1/chat/completions", "/v1/responses")
    # Process names that a cluster node's own daemons have.
    k8s_deny: tuple[str, ...] = ("dockerd", "containerd", "kubelet", "kube-proxy", "otelcol", "otelcol-contrib")
    self_comm: str = "wirelens"


DEFAULT = EngineConfig()
