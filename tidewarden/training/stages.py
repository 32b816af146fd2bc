"""Models that MLlib lacks as pipeline stages with their own reader and writer, so that all models save, load and score alike."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.session import materialize
from tidewarden.training.classifiers import prepared_by
from tidewarden.training.isolation_forest import IsolationForestModel, fit_isolation_forest
from tidewarden.training.one_class import OneClassModel, fit_one_class

KINDS = {"isolation_forest": IsolationForestModel, "one_class": OneClassModel}
DECISION = "decision"


class DecisionStage(Transformer, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """Adds a model's decision, positive for rows that are like those it was fitted on, from a vector or array column."""

    def __init__(self, model: IsolationForestModel | OneClassModel | None = None, inputCol: str = "features", outputCol: str = DECISION):  # noqa: N803
        super().__init__()
        self.model = model
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name = self.getInputCol()
        values = vector_to_array(name) if isinstance(dataset.schema[name].dataType, VectorUDT) else F.col(name)
        return dataset.withColumn(self.getOutputCol(), self.model.decision(values))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, stage: DecisionStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:  # noqa: N802
        kind = next(name for name, made in KINDS.items() if isinstance(self.stage.model, made))
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"kind": kind})
        self.stage.model.save(self.sparkSession, f"{path}/model")


class _Reader(MLReader):
    def load(self, path: str) -> DecisionStage:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = DecisionStage(KINDS[metadata["kind"]].load(self.sparkSession, f"{path}/model"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


def anomaly_pipelines(train: DataFrame, columns: list[str], row_id: str, label: str = "Label", trees: int = 100) -> dict[str, PipelineModel]:
    """The isolation forest and the one-class boundary, each behind the scaling that it was fitted on.

    The scaled vectors are written once: the boundary's steps and the forest's draws and scores pass over them some twenty times.
    """
    scaling, assembler, _ = prepared_by(train, columns, label).stages
    scaled = materialize(assembler.transform(scaling.transform(train)).select(row_id, vector_to_array("features").alias("vector")))
    found = {
        "isolation_forest": fit_isolation_forest(scaled, row_id, trees=trees),
        "one_class": fit_one_class(scaled, "vector", len(columns)),
    }
    return {name: PipelineModel(stages=[scaling, assembler, DecisionStage(model)]) for name, model in found.items()}
