"""Feature engineering, point-in-time training sets and model monitoring as
Spark DataFrame operators."""

from tidemark.spec import Feature, FeatureGroup, FeatureType, ModelVersion

__all__ = ["Feature", "FeatureGroup", "FeatureType", "ModelVersion"]
