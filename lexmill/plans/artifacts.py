"""Artifacts on disk: sharded JSONL, atomic JSON, fingerprints, manifests, and their validation."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(df: DataFrame, path: str, rows_each: int, gzip: bool = False, reuse: bool = True) -> bool:
    """Writes JSONL shards of at most ``rows_each`` rows; false if a finished write is already there and ``reuse`` is set."""
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if reuse and hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return False
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_each).option("compression", "gzip" if gzip else "none").json(path)
    return True


def save_json(path: str | Path, value: object) -> None:
    """Writes a JSON file that is there whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(path.name + ".tmp")
    with temporary.open("w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    temporary.replace(path)


def file_sha256(path: str | Path, chunk: int = 8 << 20) -> str:
    with open(path, "rb") as f:
        digest = hashlib.sha256()
        while block := f.read(chunk):
            digest.update(block)
    return digest.hexdigest()


def plan_fingerprint(plan: object, tokenizer: str) -> str:
    """SHA-256 of the plan and the tokenizer's fingerprint as JSON with sorted keys."""
    return hashlib.sha256(json.dumps({"plan": plan, "tokenizer": tokenizer}, sort_keys=True).encode()).hexdigest()


def files_fingerprint(paths: Iterable[str | Path]) -> str:
    """SHA-256 of names and bytes of files, in order of their names."""
    digest = hashlib.sha256()
    for p in sorted(map(Path, paths), key=lambda p: p.name):
        digest.update(p.name.encode())
        digest.update(p.read_bytes())
    return digest.hexdigest()


def check_resume(state: dict | None, fingerprint: str) -> int:
    """Tokens that an interrupted build has already written; raises if it was made with another plan."""
    if not state:
        return 0
    if state.get("plan_sha256") != fingerprint:
        raise ValueError("the state was made with another plan or tokenizer")
    return int(state["tokens"])


def table_digest(df: DataFrame) -> DataFrame:
    """One row: rows and a sum of row hashes that does not depend on their order (not a file hash)."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("digest"))


def manifest(parts: dict[str, DataFrame], files: Iterable[str | Path] = (), **about: object) -> dict:
    """Counts and digests of tables, sizes and SHA-256 of files, and what else is to be recorded."""
    tables = {n: df.transform(table_digest).first().asDict() for n, df in parts.items()}
    return {"schema_version": 1, **about, "tables": tables, "files": {Path(f).name: {"bytes": Path(f).stat().st_size, "sha256": file_sha256(f)} for f in files}}


def verify_files(recorded: dict, folder: str | Path) -> list[str]:
    """What is wrong with the files of a manifest: missing, of another size, or of other content."""
    wrong = []
    for name, want in recorded["files"].items():
        p = Path(folder) / name
        if not p.exists():
            wrong.append(f"{name}: missing")
        elif p.stat().st_size != want["bytes"]:
            wrong.append(f"{name}: {p.stat().st_size} bytes, not {want['bytes']}")
        elif file_sha256(p) != want["sha256"]:
            wrong.append(f"{name}: other content")
    return wrong


def token_errors(totals: DataFrame, target: int, bytes_written: int, vocabulary: int, most: int | None, item_bytes: int = 2) -> list[str]:
    """What is wrong with a token binary; ``totals`` has source, quota, tokens."""
    rows = totals.collect()  # a row for each source
    tokens = sum(r["tokens"] for r in rows)
    checks: list[tuple[bool, str]] = [
        (tokens == target, f"{tokens} tokens, not {target}"),
        (bytes_written == item_bytes * tokens, f"{bytes_written} bytes for {tokens} tokens"),
        (most is None or most < vocabulary, f"id {most} is not below {vocabulary}"),
        *((r["tokens"] == r["quota"], f"{r['source']}: {r['tokens']} tokens, not {r['quota']}") for r in rows),
    ]
    return [text for right, text in checks if not right]


def changed(recorded: dict, now: dict, keys: Iterable[str]) -> list[str]:
    """The keys in which two manifests differ."""
    return [k for k in keys if recorded.get(k) != now.get(k)]


def markdown(rows: list[dict], columns: dict[str, Callable[[object], str] | None]) -> str:
    """A Markdown table of a small result."""
    shown = [[(f or str)(r[c]) for c, f in columns.items()] for r in rows]
    return "\n".join("| " + " | ".join(x) + " |" for x in [list(columns), ["---"] * len(columns), *shown]) + "\n"


def presence(spark: SparkSession, folder: str, tables: dict[str, str]) -> list[str]:
    """Lines of a report: how many JSONL shards a folder has and its manifest, and how many rows each JSONL table, or what is missing.

    Blank lines do not count; a broken line is an error.
    """
    from ..sources.files import jsonl_paths, lines, not_blank

    shards = jsonl_paths(spark, folder)
    report = [f"shards: {len(shards)}"] if shards else [f"missing: {folder}"]
    recorded = Path(folder) / "manifest.json"
    if shards and recorded.exists():
        report.append(f"manifest: {json.dumps(json.loads(recorded.read_text(encoding='utf-8')), sort_keys=True)}")
    for label, path in tables.items():
        found = jsonl_paths(spark, path)
        parsed = F.try_parse_json(F.col("value"))
        strict = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.col("value")))).otherwise(1)
        rows = lines(spark, found).where(not_blank(F.col("value"))).agg(F.coalesce(F.sum(strict), F.lit(0))).first()[0] if found else 0
        report.append(f"{label}: {rows} rows ({path})" if found else f"missing {label}: {path}")
    return report


def load_config(path: str | Path, overrides: dict[str, object]) -> dict:
    """A configuration file (JSON, or YAML where its library is there) with dotted overrides, such as ``training.seed``, that are not None."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix in {".yaml", ".yml"}:
        try:
            import yaml
        except ImportError as error:
            raise ValueError(f"{path} needs a YAML library; write it as JSON") from error
        config = yaml.safe_load(text) or {}
    else:
        config = json.loads(text)
    for name, value in overrides.items():
        if value is None:
            continue
        *parents, last = name.split(".")
        at = config
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    return config


def chain_errors(stages: list[tuple[str, dict]], expected: list[tuple[str | None, str]], same: dict[str, object], target_tokens: int | None = None) -> list[str]:
    """What is wrong with a chain of training configurations; ``stages`` has (name, configuration) in order.

    All must have the first one's ``model`` and the values of ``same`` (dotted names). ``expected`` has, for each, the
    checkpoint it starts from and the one it writes. With ``target_tokens`` the first one's schedule must be one pass,
    rounded up to whole steps.
    """

    def value(config: dict, name: str) -> object:
        for p in name.split("."):
            config = config.get(p) if isinstance(config, dict) else None
        return config

    wrong = [f"{len(stages)} configurations for {len(expected)} stages"] if len(stages) != len(expected) else []
    for (name, config), (start, output) in zip(stages, expected):
        checks = {"model": stages[0][1].get("model"), **same, "init_checkpoint": start, "checkpoint_path": output}
        wrong += [f"{name}: {k} is {value(config, k)!r}, not {want!r}" for k, want in checks.items() if value(config, k) != want]
    if target_tokens is not None and stages:
        first = stages[0][1]
        step = value(first, "training.batch_size") * value(first, "training.gradient_accumulation_steps") * value(first, "model.context_length")
        covered = step * value(first, "training.max_steps")
        if not 0 <= covered - target_tokens < step:
            wrong.append(f"{stages[0][0]}: the schedule covers {covered} tokens, not one pass over {target_tokens}")
    return wrong


def completed(folder: str | Path, names: Iterable[str], suffixes: tuple[str, ...] = (".json", ".md")) -> list[str]:
    """The names of which all files are there; a task with one of them is done again."""
    return [n for n in names if all((Path(folder) / f"{n}{s}").is_file() for s in suffixes)]


def prepared(tasks: dict[str, Callable[[], DataFrame]], folder: str, strict: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables by task and errors by task. A table already written under ``folder`` is read again; with ``strict`` an error ends all."""
    tables, errors = {}, {}
    for name, load in tasks.items():
        try:
            df = load()
            path = f"{folder.rstrip('/')}/{name}"
            write_shards(df, path, 100_000)
            tables[name] = df.sparkSession.read.schema(df.schema).json(path)
        except Exception as error:
            if strict:
                raise
            errors[name] = f"{type(error).__name__}: {error}"
    return tables, errors


def parameters(vocabulary: int, context: int, embed: int, model: int, local: int, feature: int, blocks: int, tied: bool = True) -> int:
    """The parameters of a mixer model: embeddings, a shared local encoder, blocks of token and feature mixing, the head."""

    def linear(a: int, b: int) -> int:
        return a * b + b

    same, norm = embed == model, 2 * model
    entry = (vocabulary + context) * embed + (0 if same else linear(embed, model))
    encoder = linear(model, local) + linear(local, model) + norm
    block = 2 * linear(context, context) + linear(model, feature) + linear(feature, model) + 2 * norm
    return entry + encoder + blocks * block + norm + (0 if same and tied else model * vocabulary)
