"""Other inputs: rule files, webhook payloads, settings, model answers."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.functions.text import SEVERITIES, estimated_tokens, finding_schema_hint

#: The form of a rule line, the payload actions that matter, the echoed finding.
RULE = r"^deny\s+(\S+)\s*->\s*(\S+)$"
ACTIONS = ("opened", "synchronize")


def parse_rules(text: str) -> list[tuple[int, str, str, str]]:
    """(line, rule, from glob, to glob); blank lines and comments say nothing, any other form is an error with its line."""
    rules = []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        told = re.match(RULE, line)
        if not told:
            raise ValueError(f"line {number}: expected 'deny <from> -> <to>', got {line!r}")
        rules.append((number, line, told[1], told[2]))
    return rules


def rule_lines(files: DataFrame) -> DataFrame:
    """(line, rule, from_glob, to_glob) of ``files(text)``; reading a malformed line is an error with its number."""
    lines = files.select(F.posexplode(F.split("text", "\r?\n")).alias("at", "raw")).select((F.col("at") + 1).alias("line"), F.trim("raw").alias("rule")).where("rule <> '' and not startswith(rule, '#')")
    bad = F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": malformed rule")))
    return lines.withColumn("rule", F.when(F.col("rule").rlike(RULE), F.col("rule")).otherwise(bad)).select("line", "rule", F.regexp_extract("rule", RULE, 1).alias("from_glob"), F.regexp_extract("rule", RULE, 2).alias("to_glob"))


def pull_requests(payloads: DataFrame, event: str = "event", body: str = "body") -> DataFrame:
    """Deliveries of ``payloads`` that open or move a pull request, with their six typed fields.

    A body that is no JSON, another event or action, or a field that is missing or of another type drops the
    row; numbers in quotes are text, not numbers.
    """
    v = F.try_parse_json(F.col(body))

    def typed(path: str, kind: str, sql: str):
        value = F.try_variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(value) == kind, F.try_variant_get(v, path, sql))

    fields = {
        "action": typed("$.action", "STRING", "string"),
        "pull_number": typed("$.number", "BIGINT", "bigint"),
        "head_sha": typed("$.pull_request.head.sha", "STRING", "string"),
        "base_ref": typed("$.pull_request.base.ref", "STRING", "string"),
        "owner": typed("$.repository.owner.login", "STRING", "string"),
        "repo": typed("$.repository.name", "STRING", "string"),
        "clone_url": typed("$.repository.clone_url", "STRING", "string"),
    }
    rows = payloads.where(F.col(event) == "pull_request").select("*", *(c.alias(n) for n, c in fields.items()))
    return rows.where(F.col("action").isin(*ACTIONS)).na.drop(subset=[n for n in fields]).drop(event, body)


#: The settings that may be given, by name, with their kind and what they must fulfil.
PROVIDERS = ("echo", "openai", "gemini")
BOUNDS = {"port": (1, 65535), "llm_max_output_tokens": (256, 200_000), "llm_temperature": (0, 2), "context_token_budget": (1_000, 2_000_000), "blast_radius_max_hops": (1, 10)}
CHOICES = {"node_env": ("development", "test", "production"), "llm_provider": PROVIDERS, "review_fail_on": (*SEVERITIES, "never")}
KEYS = {"openai": "openai_api_key", "gemini": "google_api_key"}


@dataclass(frozen=True)
class Settings:
    """Validated settings; a provider other than echo needs its key. All that is wrong is told at once."""

    node_env: str = "development"
    port: int = 3000
    llm_provider: str = "echo"
    llm_model: str | None = None
    llm_max_output_tokens: int = 4096
    llm_temperature: float = 0.0
    openai_api_key: str | None = None
    google_api_key: str | None = None
    context_token_budget: int = 60_000
    blast_radius_max_hops: int = 3
    database_url: str | None = None
    github_webhook_secret: str | None = None
    github_token: str | None = None
    review_fail_on: str = "high"

    @classmethod
    def read(cls, *files: str, environment: dict[str, str] | None = None) -> "Settings":
        """Earlier files win over later ones and the environment over all."""
        values: dict[str, str] = {}
        for path in reversed(files):
            if os.path.exists(path):
                values.update(re.findall(r"(?m)^\s*([A-Z_]+)\s*=\s*\"?(.*?)\"?\s*$", open(path).read()))
        values.update(environment if environment is not None else os.environ)
        given, wrong = {}, []
        for name, setting in cls.__dataclass_fields__.items():
            text = values.get(name.upper())
            if text is None:
                continue
            kind = type(setting.default) if setting.default is not None else str
            try:
                value = kind(text.strip())
            except ValueError:
                wrong.append(f"{name.upper()} must be a number")
                continue
            if value == "":
                wrong.append(f"{name.upper()} must not be blank")
            low, high = BOUNDS.get(name, (value, value))
            if not low <= value <= high:
                wrong.append(f"{name.upper()} must be {low} to {high}")
            if value not in CHOICES.get(name, (value,)):
                wrong.append(f"{name.upper()} must be one of {', '.join(CHOICES[name])}")
            given[name] = value
        made = cls(**given)
        if made.database_url and not re.match(r"postgres(ql)?://", made.database_url):
            wrong.append("DATABASE_URL must be a postgres:// address")
        if (needed := KEYS.get(made.llm_provider)) and not getattr(made, needed):
            wrong.append(f"{needed.upper()} is required for {made.llm_provider}")
        if wrong:
            raise ValueError("; ".join(wrong))
        return made


def echo_answers(prompts: DataFrame, key: str, prompt: str = "prompt") -> DataFrame:
    """(key, refs, file, input_tokens): the deterministic answer: cited ids in first-seen order and the first source path."""
    refs = F.array_distinct(F.transform(F.regexp_extract_all(prompt, F.lit(r"\[(E\d+)\]"), 1), lambda x: x))
    file = F.nullif(F.regexp_extract(prompt, r"([\w./-]+\.(?:tsx?|jsx?|mjs|cjs))\b", 1), F.lit(""))
    return prompts.select(key, refs.alias("refs"), file.alias("file"), F.ceil(F.length(prompt) / 4).cast("long").alias("input_tokens"), estimated_tokens(F.col(prompt)).alias("upper_tokens"))


def completed(prompts: DataFrame, complete: Callable[[str], object], check: Callable[[str], tuple[list | None, str | None]], key: str, prompt: str = "prompt", tries: int = 3) -> DataFrame:
    """(key, answer, calls, problem, input_tokens, output_tokens): a model asked up to ``tries`` times, each time told
    what was wrong before and which form is expected.

    The model is any callable that gives a text or ``models.Answer``; it is called from the executors, batch by batch.
    Tokens are summed over all calls, also the refused ones, and null where any call did not count them.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, text in frame.itertuples(index=False):
                said, answer, problem, calls, used = text, None, None, 0, []
                while calls < tries:
                    calls += 1
                    told = complete(said)
                    answer = getattr(told, "text", told)
                    used.append((getattr(told, "input_tokens", None), getattr(told, "output_tokens", None)))
                    _, problem = check(answer)
                    if problem is None:
                        break
                    said = f"{text}\n\nYour last answer was not accepted: {problem}\nAnswer again with JSON only, in this form:\n{finding_schema_hint()}"
                sums = [sum(x) if x and None not in x else None for x in zip(*used)] or [None, None]
                rows.append((k, answer, calls, problem, *sums))
            yield pd.DataFrame(rows, columns=[key, "answer", "calls", "problem", "input_tokens", "output_tokens"]).astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string, calls int, problem string, input_tokens bigint, output_tokens bigint")
