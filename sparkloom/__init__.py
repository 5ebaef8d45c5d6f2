"""sparkloom: a small PySpark-native engine. Importing it starts nothing and loads no subpackage."""
