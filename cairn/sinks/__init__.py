"""Writers of point files, images and reports."""
