"""Settings of the pipeline, from the environment where given, checked before anything starts."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

_DURATION = re.compile(r"\s*\d+\s+(milli|micro)?(second|minute|hour|day|week)s?\s*", re.I)


@dataclass(frozen=True)
class Rules:
    """What a domain fixes: its states, moves, decisions and ranges. The defaults are fixed values of the credit-proposal domain."""

    edges: tuple[tuple[str, str], ...] = (
        ("em_analise", "pendente_documentacao"),
        ("em_analise", "aprovada"),
        ("em_analise", "recusada"),
        ("em_analise", "cancelada"),
        ("pendente_documentacao", "em_analise"),
        ("pendente_documentacao", "aprovada"),
        ("pendente_documentacao", "recusada"),
        ("pendente_documentacao", "cancelada"),
        ("aprovada", "paga"),
        ("aprovada", "cancelada"),
    )
    statuses: tuple[str, ...] = ("em_analise", "pendente_documentacao", "aprovada", "recusada", "paga", "cancelada", "deletada")
    deleted: str = "deletada"
    decisions: tuple[str, ...] = ("aprovada", "recusada")
    ranges: tuple[tuple[str, float, float], ...] = (("consignado", 1_000.0, 50_000.0), ("cartao", 500.0, 15_000.0), ("fgts", 1_000.0, 27_000.0))
    common_fields: tuple[str, ...] = ("_id", "id_proposta", "tipo_produto", "cpf_cliente", "nome_cliente", "valor_solicitado", "status", "data_criacao", "data_atualizacao")

    @property
    def terminals(self) -> tuple[str, ...]:
        starts = {a for a, _ in self.edges}
        return tuple(s for s in self.statuses if s not in starts and s != self.deleted)


@dataclass(frozen=True)
class Settings:
    """Durations are strings as Spark reads them. ``strict_late_state``: keep the plain time guard of the state upsert (see ``operators.state``).

    The connector hands on at most ``max_events_per_trigger`` events, or what there is after ``connector_trigger``.
    """

    root: str = "tidemark-tables"
    checkpoints: str = "tidemark-checkpoints"
    watermark: str = "10 minutes"
    window: str = "1 day"
    trigger: str = "10 seconds"
    max_files_per_trigger: int = 50
    merge_buckets: int = 64
    retry_first_ms: int = 1_000
    retry_most_ms: int = 30_000
    strict_late_state: bool = False
    collection: str = "tidemark-collection"
    connector_trigger: str = "2 seconds"
    max_events_per_trigger: int = 50
    log_format: str = "tidemark_log"
    log_path: str = "tidemark-log"
    log_servers: str = ""
    log_topic: str = "changes"
    load_per_second: int = 5
    load_seed: int = 42
    rules: Rules = field(default_factory=Rules)

    def __post_init__(self):
        for name in ("max_files_per_trigger", "merge_buckets", "retry_first_ms", "max_events_per_trigger", "load_per_second"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above zero")
        if self.retry_most_ms < self.retry_first_ms:
            raise ValueError("retry_most_ms must not be below retry_first_ms")
        for name in ("watermark", "window", "trigger", "connector_trigger"):
            if not _DURATION.fullmatch(getattr(self, name)):
                raise ValueError(f"{name} is no duration: {getattr(self, name)!r}")
        if self.log_format not in ("tidemark_log", "kafka"):
            raise ValueError(f"log_format must be tidemark_log or kafka, not {self.log_format!r}")
        if self.log_format == "kafka" and not self.log_servers:
            raise ValueError("log_servers must name the servers of the log")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "TIDEMARK_") -> Settings:
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None or raw == "" or f.name == "rules":
                continue
            if f.type == "int":
                try:
                    given[f.name] = int(raw)
                except ValueError as e:
                    raise ValueError(f"{prefix}{f.name.upper()} must be an integer, not {raw!r}") from e
            elif f.type == "bool":
                if raw.lower() not in ("true", "false", "0", "1"):
                    raise ValueError(f"{prefix}{f.name.upper()} must be true or false, not {raw!r}")
                given[f.name] = raw.lower() in ("true", "1")
            else:
                given[f.name] = raw
        return cls(**given)
