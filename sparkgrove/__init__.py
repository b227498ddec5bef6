"""Spark-native document retrieval and grounding analytics.

Importing the package pulls in no Spark session and no optional subpackage;
sessions come from the caller or from :func:`sparkgrove.session.get_session`.
"""

__version__ = "0.1.0"
