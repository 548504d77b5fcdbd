"""Text generation as pluggable column functions; a deterministic stand-in is the default."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import prompts as P
from graphloom.functions import text as T
from graphloom.storage import bounded_batches

#: The fields of an explanation.
EXPLANATION = "role_tag string, one_liner string, why_it_exists string, used_by array<string>, calls array<string>, side_effects array<string>, risk_note string"
#: Seconds a model has for an answer, and prompts that a task has under way at once.
TIMEOUT, WORKERS = 120.0, 2
Model = Callable[[str], str]


class GenerationError(RuntimeError):
    """A model cannot be reached, answers with an error, is missing, or takes too long: what a pass records and goes on from."""

    @classmethod
    def of(cls, status: int | None, model: str, said: str = "") -> GenerationError:
        if status is None:
            return cls(f"the model server cannot be reached ({said}); start it and try again")
        if status == 404 or "not found" in said.lower():
            return cls(f"model {model} is not there ({said}); pull it first")
        return cls(f"the model server answered {status}: {said}")


@dataclass(frozen=True)
class HttpModel:
    """A model behind an HTTP endpoint that takes and gives JSON; answers are deterministic (temperature 0).

    schema: a JSON schema that constrains the answer. stop: strings at which the answer ends.
    """

    url: str
    model: str
    system: str = P.SYSTEM
    schema: dict | None = None
    stop: tuple[str, ...] = ()
    timeout: float = TIMEOUT

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "system": self.system, "prompt": prompt, "stream": False, "options": {"temperature": 0} | ({"stop": list(self.stop)} if self.stop else {})}
        if self.schema is not None:
            body["format"] = self.schema
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read().decode())["response"]
        except urllib.error.HTTPError as e:
            raise GenerationError.of(e.code, self.model, e.read().decode(errors="replace")) from e
        except (urllib.error.URLError, TimeoutError) as e:
            raise GenerationError.of(None, self.model, str(e)) from e


def stub(prompt: str) -> str:
    """An explanation made of the prompt alone, as JSON."""
    head = prompt.splitlines()[0] if prompt else ""
    return json.dumps({"role_tag": "utility", "one_liner": head[:80], "why_it_exists": f"{len(prompt)} characters", "used_by": [], "calls": [], "side_effects": [], "risk_note": None})


def generate(prompt: Column, model: Model = stub, stop: tuple[str, ...] = (), timeout: float = TIMEOUT, workers: int = WORKERS) -> Column:
    """struct<text, error>: the model's answer up to the first of stop, or what went wrong with it.

    A GenerationError and a missed timeout are errors of the row, so that one failure does not end a pass; any other
    exception is a fault of the program and ends the job. A null prompt asks nothing. Each task has `workers` prompts
    under way.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(workers)
        try:
            for prompts in batches:
                asked = [None if p is None else pool.submit(model, p) for p in prompts]
                rows: list[tuple[str | None, str | None]] = []
                for job in asked:
                    try:
                        text = None if job is None else job.result(timeout)
                        for s in stop if text is not None else ():
                            text = text.partition(s)[0]
                        rows.append((text, None))
                    except GenerationError as e:
                        rows.append((None, str(e)))
                    except Late:
                        job.cancel()
                        rows.append((None, f"no answer within {timeout:g} seconds"))
                yield pd.DataFrame(rows, columns=["text", "error"], dtype=object)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)  # a call that hangs does not hold the task

    return F.pandas_udf(run, "text string, error string")(prompt)


def parse_explanation(answer: Column) -> Column:
    """The answer's fields; null where it is not a JSON object."""
    return F.when(F.startswith(F.ltrim(answer), F.lit("{")) & F.try_parse_json(answer).isNotNull(), F.from_json(answer, EXPLANATION))


def known_neighbours(explanation: Column, callers: Column, callees: Column) -> Column:
    """The explanation without names that its function's callers and callees (arrays of names) lack."""
    clean = explanation.withField("used_by", T.keep_known(explanation["used_by"], callers)).withField("calls", T.keep_known(explanation["calls"], callees))
    return F.when(explanation.isNotNull(), clean)


def explain(functions: DataFrame, model: Model = stub, reason: Model | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """functions with explanation and error, in two stages: free reasoning up to a brace, then the JSON object.

    functions: fn_source; callers and callees, array<struct<name, file, line>> in rank order; callers_omitted and
    callees_omitted; retrieved, array<struct<rel_fname, start_line, end_line, text>>. reason: the model of the first
    stage, the same by default. A failure of either stage, or an answer that is no JSON object, leaves a null
    explanation and its error.
    """
    bounded_batches(functions.sparkSession)  # a prompt is several KB, and a worker holds a batch of them
    names = lambda c: F.transform(c, lambda x: x["name"])
    bundle = P.context_bundle(F.col("callers"), F.col("callers_omitted"), F.col("callees"), F.col("callees_omitted"), F.col("retrieved"))
    parts = [F.col("fn_source"), names(F.col("callers")), names(F.col("callees"))]
    out = functions.withColumn("gl_bundle", bundle)
    out = out.withColumn("gl_reasoning", generate(P.reasoning_prompt(*parts, F.col("gl_bundle")), reason or model, ("{",), timeout))
    ask = F.when(F.col("gl_reasoning.error").isNull(), P.json_prompt(*parts, F.col("gl_bundle"), F.col("gl_reasoning.text")))
    out = out.withColumn("gl_answer", generate(ask, model, (), timeout))
    out = out.withColumn("explanation", known_neighbours(parse_explanation(F.col("gl_answer.text")), names(F.col("callers")), names(F.col("callees"))))
    error = F.coalesce("gl_reasoning.error", "gl_answer.error", F.when(F.col("explanation").isNull(), F.lit("the answer is no JSON object")))
    return out.withColumn("error", error).drop("gl_bundle", "gl_reasoning", "gl_answer")


def acceptance_report(explained: DataFrame) -> DataFrame:
    """explained(..., explanation, callers, callees) with issues, notes and passed."""
    e = F.col("explanation")
    names = lambda c: F.transform(c, lambda x: x["name"])
    issues = F.when(e.isNull(), F.array(F.lit("no valid answer"))).otherwise(T.json_issues(F.to_json(e, {"ignoreNullFields": "false"})))
    given = F.concat(names(F.col("callers")), names(F.col("callees")))
    none = F.array().cast("array<string>")
    notes = F.when(e.isNull(), none).otherwise(T.quality_notes(e["why_it_exists"], F.coalesce(e["side_effects"], none), e["used_by"], e["calls"], given))
    return explained.withColumn("issues", issues).withColumn("notes", notes).withColumn("passed", F.size("issues") == 0)


def acceptance_markdown(report: DataFrame, title: str, model_id: str) -> DataFrame:
    """One row, text: a Markdown report of acceptance_report(), in the order of pos. The sample is a bounded list."""
    listed = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(f"**{head}:**\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n"))).otherwise("")
    names = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x["name"]), ", ")).otherwise("none")
    status = F.when(F.col("passed"), "passed").otherwise(F.concat(F.size("issues").cast("string"), F.lit(" issue(s)")))
    part = F.concat(
        F.lit("## `"), "name", F.lit("`, "), "rel_fname", F.lit(":"), F.col("line").cast("string"), F.lit(" ["), status, F.lit("]\n\n"), listed("Issues", F.col("issues")), listed("Notes", F.col("notes")),
        F.lit("**Callers:** "), names(F.col("callers")), F.lit("\n**Callees:** "), names(F.col("callees")), F.lit("\n\n```\n"), "fn_source", F.lit("\n```\n\n```json\n"), F.coalesce(F.to_json("explanation"), F.lit("null")),
        F.lit("\n```\n\n**Verdict:** [ ] correct and not obvious [ ] wrong, obvious or generic\n\n---\n"),
    )
    rows = report.select("pos", "passed", part.alias("part")).agg(F.count("*").alias("n"), F.count_if("passed").alias("ok"), F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    head = F.concat(F.lit(f"# Acceptance report: {title}\n\n- Model: `{model_id}`\n- Functions: "), F.col("n").cast("string"), F.lit("\n- Passed: "), F.col("ok").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit("\n\n---\n\n"))
    return rows.select(F.concat(head, F.array_join(F.transform("parts", lambda x: x["part"]), "\n")).alias("text"))
