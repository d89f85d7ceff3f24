"""stratlas: a PySpark-native analytics engine for catalogues of software projects."""
