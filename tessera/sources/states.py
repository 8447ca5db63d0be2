"""Saved states as Parquet with a small metadata table; paths and trees by recursive SQL; replay as a fold of views."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.views import apply_view

SCHEMA = "id string, parent_id string, title string, operation string, params string, rows long, columns int, path string"


class StateStore:
    """States below a folder: save(), load(), path(), tree(), replay(), delete(); steps come from a registry of functions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.steps: dict[str, Callable[..., DataFrame]] = {"view": lambda df, **view: apply_view(df, view)}

    @property
    def states(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/states/*")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def register(self, name: str, step: Callable[..., DataFrame] | str) -> None:
        """A named step: a function of a DataFrame, or SQL text over {df}; stored text is never executed as Python."""
        self.steps[name] = (lambda df, **kw: self.spark.sql(step, args=kw, df=df)) if isinstance(step, str) else step

    def save(self, df: DataFrame, title: str, parent_id: str | None = None, operation: str = "checkpoint", params: dict | None = None) -> str:
        key = uuid.uuid4().hex
        path = f"{self.folder}/data/{key}"
        df.write.parquet(path)
        n = self.spark.read.parquet(path).count()
        self.spark.createDataFrame([(key, parent_id, title, operation, json.dumps(params or {}, sort_keys=True), n, len(df.columns), path)], SCHEMA).coalesce(1).write.parquet(f"{self.folder}/states/{key}")
        return key

    def load(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self.states.where(F.col("id") == key).first()["path"])

    def tree(self, key: str) -> DataFrame:
        """The state and all that descend from it."""
        return descendants(self.states, key)

    def path(self, key: str) -> DataFrame:
        """From the root to the state."""
        return ancestors(self.states, key)

    def run_flow(self, df: DataFrame, steps: list[tuple[str, dict]] | DataFrame) -> DataFrame:
        """The steps, pairs of a name and its arguments or a table of flow_from_path(), applied one after the other."""
        for name, kwargs in step_list(steps):
            df = df.transform(self.steps[name], **kwargs)
        return df

    def run_flow_saved(self, df: DataFrame, steps: list[tuple[str, dict]] | DataFrame, title: str, parent_id: str | None = None) -> list[str]:
        """run_flow() with a state for the source, unless a parent is given, and one after each step; their ids in order."""
        keys = [self.save(df, title, operation="checkpoint")] if parent_id is None else [parent_id]
        for name, kwargs in step_list(steps):
            keys.append(self.save(self.steps[name](self.load(keys[-1]), **kwargs), f"{title}: {name}", keys[-1], name, kwargs))
        return keys if parent_id is None else keys[1:]

    def flow_from_path(self, key: str) -> DataFrame:
        """step, operation, params, title, state_id: the steps from the root to a state as a table; checkpoints are no steps."""
        above = self.path(key).where((F.col("operation") != "checkpoint") & F.col("parent_id").isNotNull())
        place = F.row_number().over(Window.orderBy(F.desc("depth")))  # a row a step of one path
        return above.select(place.alias("step"), "operation", "params", "title", F.col("id").alias("state_id"))

    def save_flow(self, name: str, steps: DataFrame) -> None:
        """Keeps a flow by name, beside the states that it came from and independent of them."""
        steps.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/flows/{name}")

    def flow(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/flows/{name}")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop_data(self, key: str) -> None:
        """Removes a state's stored rows; the state itself stays and can be replayed."""
        self._remove(self.states.where(F.col("id") == key).first()["path"])

    def nearest_snapshot(self, key: str) -> tuple[str | None, list[tuple[str, dict]]]:
        """The nearest state with stored rows, from the state itself upwards, and the steps that lead on from it to the state."""
        rows, steps = self.path(key).orderBy("depth").collect(), []
        if not rows:
            raise ValueError(f"no state {key}")
        for r in rows:
            if self._exists(r["path"]):
                return r["id"], steps
            if r["operation"] != "checkpoint":
                steps.insert(0, (r["operation"], json.loads(r["params"])))
        return None, steps

    def replay(self, key: str, source: DataFrame | None = None) -> DataFrame:
        """A state made anew: by all steps of its path from a given source, else by those after the nearest state with stored rows.

        Checkpoints change nothing; unknown steps, and a path without stored rows where no source is given, raise.
        """
        if source is None:
            start, steps = self.nearest_snapshot(key)
            if start is None:
                raise ValueError(f"cannot replay {key}: no state on its path has stored rows; give a source")
            source = self.load(start)
        else:
            rows = self.path(key).orderBy(F.desc("depth")).collect()
            steps = [(r["operation"], json.loads(r["params"])) for r in rows if r["operation"] != "checkpoint"]
        if unknown := [name for name, _ in steps if name not in self.steps]:
            raise ValueError(f"cannot replay {key}: no step named {', '.join(unknown)}")
        return self.run_flow(source, steps)

    # --- dependencies ---------------------------------------------------------------------------------------------

    @property
    def dependencies(self) -> DataFrame:
        """child, parent, variable: parents of states, and the states that they take further tables from."""
        own = self.states.where("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("parent"), F.lit(None).cast("string").alias("variable"))
        try:
            return own.unionByName(self.spark.read.schema("child string, parent string, variable string").parquet(f"{self.folder}/dependencies/*"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return own

    def depend(self, child: str, parent: str, variable: str) -> None:
        """The child's step takes the parent's rows as its argument `variable`. A circle is refused."""
        if any(r["id"] == parent for r in self.stale(child).collect()):
            raise ValueError(f"{parent} already depends on {child}")
        self.spark.createDataFrame([(child, parent, variable)], "child string, parent string, variable string").coalesce(1).write.parquet(f"{self.folder}/dependencies/{uuid.uuid4().hex}")

    def stale(self, key: str) -> DataFrame:
        """id, depth: the state (depth 0) and all that depend on it, at the length of the longest way; in that order nothing comes before what it takes."""
        down = "WITH RECURSIVE t(id, depth) AS (SELECT :key, 0 UNION ALL SELECT d.child, t.depth + 1 FROM {d} d JOIN t ON d.parent = t.id) SELECT id, max(depth) AS depth FROM t GROUP BY id"
        return self.spark.sql(down, args={"key": key}, d=self.dependencies)

    def update(self, key: str, df: DataFrame) -> None:
        """New rows for a state: written beside the old ones, which go once the state points to the new."""
        old = self.states.where(F.col("id") == key).first().asDict()
        path = f"{self.folder}/data/{key}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        new = old | {"path": path, "rows": self.spark.read.parquet(path).count(), "columns": len(df.columns)}
        self.spark.createDataFrame([tuple(new[f.split()[0]] for f in SCHEMA.split(", "))], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/states/{key}")
        self._remove(old["path"])

    def push_dependencies(self, key: str) -> DataFrame:
        """Runs the steps of all states that depend on a state, each once and after what it takes; place, id, title, rows of those run.

        States without a step of their own (checkpoints) keep their rows.
        """
        order = self.stale(key).where("depth > 0").join(self.states, "id").orderBy("depth", "id").collect()
        if unknown := [r["operation"] for r in order if r["operation"] not in (*self.steps, "checkpoint")]:
            raise ValueError(f"no step named {', '.join(unknown)}")
        taken, done = {}, []
        for d in self.dependencies.where("variable is not null").collect():
            taken.setdefault(d["child"], {})[d["variable"]] = d["parent"]
        for r in order:
            if r["operation"] != "checkpoint":
                more = {name: self.load(k) for name, k in taken.get(r["id"], {}).items()}
                self.update(r["id"], self.steps[r["operation"]](self.load(r["parent_id"]), **json.loads(r["params"]), **more))
                done.append((len(done) + 1, r["id"]))
        made = self.spark.createDataFrame(done, "place int, id string")
        return made.join(self.states.select("id", "title", "rows"), "id").select("place", "id", "title", "rows")

    def delete(self, key: str) -> list[str]:
        """Removes a state and its descendants; returns their ids."""
        ids = [r["id"] for r in self.tree(key).collect()]
        paths = {r["id"]: r["path"] for r in self.states.where(F.col("id").isin(ids)).collect()}
        for i in ids:
            self._remove(paths[i])
            self._remove(f"{self.folder}/states/{i}")
        return ids


def step_list(steps: list[tuple[str, dict]] | DataFrame) -> list[tuple[str, dict]]:
    if isinstance(steps, list):
        return steps
    return [(r["operation"], json.loads(r["params"])) for r in steps.orderBy("step").collect()]


def descendants(states: DataFrame, key: str) -> DataFrame:
    return states.sparkSession.sql("WITH RECURSIVE t(id, depth) AS (SELECT id, 0 FROM {s} WHERE id = :key UNION ALL SELECT c.id, t.depth + 1 FROM {s} c JOIN t ON c.parent_id = t.id) SELECT * FROM t", args={"key": key}, s=states)


def ancestors(states: DataFrame, key: str) -> DataFrame:
    up = "WITH RECURSIVE t(id, parent_id, depth) AS (SELECT id, parent_id, 0 FROM {s} WHERE id = :key UNION ALL SELECT p.id, p.parent_id, t.depth + 1 FROM {s} p JOIN t ON p.id = t.parent_id) SELECT id, depth FROM t"
    return states.sparkSession.sql(up, args={"key": key}, s=states).join(states, "id")
