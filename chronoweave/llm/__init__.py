"""Training-data pipeline operators: detection, de-duplication, filtering, mixing and packing of documents."""
