"""Parameters of a run. Every operator takes what it needs from here."""

from __future__ import annotations

from dataclasses import dataclass, field

from corpusloom import fixed_values as fv


@dataclass(frozen=True)
class Settings:
    source_extensions: list[str] = field(default_factory=lambda: list(fv.SOURCE_EXTENSIONS))
    exclude_dirs: list[str] = field(default_factory=lambda: list(fv.EXCLUDED_DIRS))
    include_tests: bool = False
    max_file_bytes: int = fv.MAX_FILE_BYTES
    max_files: int | None = None
    chunk_token_budget: int = fv.CHUNK_TOKEN_BUDGET
    max_input_tokens: int = fv.MAX_INPUT_TOKENS
    cache_enabled: bool = True
    redact_secrets: bool = True
    extra_rules: tuple[tuple[str, str, str], ...] = ()
    model: str = fv.DEFAULT_MODEL

    @property
    def active_exclude_dirs(self) -> list[str]:
        kept = fv.TEST_DIRS if self.include_tests else []
        return [d for d in self.exclude_dirs if d not in kept]

    @property
    def secret_rules(self) -> list[tuple[str, str, str]]:
        """Built-in rules followed by the project's own; none when redaction is off."""
        return [*fv.SECRET_RULES, *self.extra_rules] if self.redact_secrets else []

    @property
    def reduce_budget(self) -> int:
        return self.max_input_tokens - fv.REDUCE_RESERVE_TOKENS
