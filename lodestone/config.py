"""Defaults of the engine."""

from dataclasses import dataclass

# Directories that are never indexed, and the extensions that are.
IGNORED_DIRS = (".git", ".vs", "bin", "obj", "node_modules")
METADATA_DIR = ".lodestone"
TEXT_EXTENSIONS = (
    "txt", "md", "markdown", "json", "yml", "yaml", "xml", "ini", "toml", "csv", "log", "cs", "csproj", "props", "targets", "sln", "slnx",
    "js", "ts", "jsx", "tsx", "py", "java", "go", "rs", "sql", "ps1", "sh", "html", "css", "scss",
)


@dataclass(frozen=True)
class Config:
    chunk_tokens: int = 256
    chunk_overlap: int = 32
    dimension: int = 64
    embed_batch: int = 64
    max_file_bytes: int = 1 << 20
    top_k: int = 5
    min_score: float = 0.0
    floor: float = 0.0
    gap: float = 0.5
    lexical_weight: float = 0.3
    diversity: float = 0.7
    budget_tokens: int = 2000
    grep_rows: int = 200
    grep_chars: int = 64_000
    read_lines: int = 400
    read_chars: int = 200_000
    glob_rows: int = 200
    examined: int = 100_000
    search_file_bytes: int = 4 << 20
    search_s: float = 10.0
    match_s: float = 1.0
    message_chars: int = 4000
    settle_s: float = 0.25
    retry_s: float = 1.0
    retries: int = 5
    listing: int = 500
    debounce_ms: int = 750
    max_attempts: int = 10
    backoff_s: float = 1.0
    backoff_cap_s: float = 300.0
    retention_days: int = 1

    @property
    def step(self) -> int:
        return self.chunk_tokens - self.chunk_overlap

    def __post_init__(self):
        if self.chunk_tokens <= 0 or not 0 <= self.chunk_overlap < self.chunk_tokens:
            raise ValueError("the overlap must be smaller than the chunk")


DEFAULT = Config()
