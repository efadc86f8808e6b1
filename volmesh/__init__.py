"""Jobs on Spark for volumes and tetrahedral meshes: load, transform, partition, summarise, select, query."""
