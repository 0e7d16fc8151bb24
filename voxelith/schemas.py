"""Table schemas, as DDL. Voxels are rows; label 1 is the background, 0 in a seed image is no seed."""

VOXELS = "image_id string, t int, x long, y long, z int, v double"
LABELS = "image_id string, t int, x long, y long, z int, label int"
CELLS = "cell_id long, volume long, h_min double, sigma double, name string"
EDGES = "parent long, child long, ord int"
TRSF = "trsf_id string, type string, unit string, mat array<double>"
DETECTIONS = "x double, y double, z double, r1 double, r2 double, arg1 double, arg2 int, arg3 int, arg4 int, arg5 double"
IMAGES = "image_id string, path string, xdim int, ydim int, zdim int, vdim int, dtype string, vx double, vy double, vz double, info map<string,string>"
#: Cell ids are t * FRAME + number.
FRAME = 10_000
XYZ = ("x", "y", "z")
