"""talentgrid — CV / job-offer matching and analytics as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) that only builds a logical plan; Catalyst/AQE pick the physical
strategy. Vocabularies are small literal tables passed as arguments.
"""

from talentgrid.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
