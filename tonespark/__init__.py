"""PySpark-native analytics of audio and other ordered sample streams."""
