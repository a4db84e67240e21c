"""Origin-destination panels on Spark: keys, routing, crosswalks, panels, space, splits and models."""
