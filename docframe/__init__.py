"""docframe: structuring and annotating collections of long documents on Spark."""
