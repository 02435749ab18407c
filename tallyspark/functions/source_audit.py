"""Checks of submitted Python sources and configurations: what no SQL expression can see.

The checks are pure functions over text; ``audit_column`` and its like run them over a column in Arrow batches.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.yaml_text import top_level


@dataclass(frozen=True)
class Policy:
    """What a source must not do."""

    modules: frozenset[str] = frozenset()
    calls: frozenset[str] = frozenset()
    loader: str = "from_pretrained"
    loader_name: str = "model_name"


# What a submitted source must not import or call.
DEFAULT_POLICY = Policy(
    modules=frozenset({"requests", "urllib", "urllib2", "urllib3", "httpx", "aiohttp", "socket", "huggingface_hub", "importlib", "torch.hub"}),
    calls=frozenset({"snapshot_download", "hf_hub_download", "cached_download", "pipeline", "eval", "exec", "compile", "__import__", "import_module", "torch.hub.load"}),
)


def _dotted(node: ast.expr) -> str:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else ".".join(reversed(parts))


def source_reason(source: str | None, policy: Policy) -> str | None:
    """The first objection to a source, in breadth-first order of its tree; null if there is none."""
    if not (source or "").strip():
        return "miner_py_empty"
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError) as error:
        return f"miner_py_syntax_error:{error}"
    banned = lambda name: any(name == m or name.startswith(f"{m}.") for m in policy.modules)
    for node in nodes:
        match node:
            case ast.Import(names=names):
                bad = [x.name for x in names if banned(x.name)]
                if bad:
                    return f"banned_import:{bad[0]}"
            case ast.ImportFrom(module=module) if banned(module or ""):
                return f"banned_import_from:{module}"
            case ast.Call(func=func, args=args, keywords=keywords):
                name = _dotted(func)
                if name in policy.calls or name.rpartition(".")[2] in policy.calls:
                    return f"banned_call:{name}"
                if name.rpartition(".")[2] == policy.loader:
                    given = args[0] if args else next((k.value for k in keywords if k.arg == "pretrained_model_name_or_path"), None)
                    if not (isinstance(given, ast.Name) and given.id == policy.loader_name):
                        return f"{policy.loader}_must_use_{policy.loader_name}"
    return None


def constants(source: str | None, names: tuple[str, ...]) -> dict[str, str]:
    """Text constants bound at module level, the last binding of each name; empty where there is none."""
    try:
        body = ast.parse(source or "").body
    except (SyntaxError, ValueError):
        body = []
    bound = {s.targets[0].id: s.value.value for s in body if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)}
    return {n: bound.get(n, "") for n in names}


def masked_text(source: str, masked: tuple[str, ...]) -> str:
    """The source with what is assigned to the masked names emptied, wherever it stands: from the first quote after the sign to the next one."""
    for name in masked:
        source = re.sub(rf"""{re.escape(name)}\s*=\s*["'].*?["']""", f'{name} = ""', source, flags=re.DOTALL)
    return source


def normalized_hash(source: str | None, masked: tuple[str, ...]) -> str | None:
    """sha256 of the syntax tree, without positions, of the source with ``masked`` emptied in its text; null for a syntax error.

    Comparable only between runs of one Python version.
    """
    try:
        tree = ast.parse(masked_text(source or "", masked))
    except (SyntaxError, ValueError):
        return None
    return hashlib.sha256(ast.dump(tree).encode()).hexdigest()


def script_reason(source: str | None, canonical: str, masked: tuple[str, ...]) -> str | None:
    """Objection to a deployed script that is not the canonical one but for the text constants of ``masked`` and formatting."""
    if not (source or "").strip():
        return "empty_deploy_script"
    found = normalized_hash(source, masked)
    if found is None:
        return "deploy_script_syntax_error"
    return None if found == normalized_hash(canonical, masked) else "wrapper_hash_mismatch"


def hash_reason(source: Column, expected: str) -> Column:
    """Objection to a source that is not, byte for byte, the one with the expected sha256."""
    text = F.coalesce(source, F.lit(""))
    return F.when(text == "", "miner_py_empty").when(F.sha2(text, 256) != expected, "miner_py_hash_mismatch")


def config_reason(text: str | None, expected: str, key: str = "model_name") -> str | None:
    """Objection to a YAML configuration whose top-level ``key`` must have the expected value."""
    if not (text or "").strip():
        return "config_empty"
    try:
        found = top_level(text)
    except ValueError:
        return "config_parse_error"
    if found is None:
        return "config_not_a_mapping"
    value = (found.get(key) or "").strip()
    if not value or value in ("False", "0", "0.0"):
        return f"config_missing_{key}"
    return None if value == expected else f"{key}_mismatch:yaml={value}"


def text_column(check: Callable[[str | None], str | None], column: Column) -> Column:
    """A check of one text over a column."""

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: check(None if v is None else v))

    return run(column)


def audit_column(column: Column, policy: Policy) -> Column:
    return text_column(lambda s: source_reason(s, policy), column)
