"""Sources and sinks: INR, TIFF, NPY images, detections, transformations, lineage files, Tulip graphs."""
