"""Reading-state analytics on PySpark: libraries of documents, views of them and streams of view updates."""
