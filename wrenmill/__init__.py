"""wrenmill: case resolution, graph reconstruction and diagnostic hierarchies as Spark DataFrame transformations."""
