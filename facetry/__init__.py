"""A semantic metrics engine on PySpark: metrics by dimensions as DataFrame plans."""

from .layer import SemanticLayer
from .model import DefinitionError, Dimension, Explore, Metric, Model, Parameter, PreAggregation, Relationship, SavedQuery, SecurityPolicy, Segment

__all__ = ["DefinitionError", "Dimension", "Explore", "Metric", "Model", "Parameter", "PreAggregation", "Relationship", "SavedQuery", "SecurityPolicy", "Segment", "SemanticLayer"]
