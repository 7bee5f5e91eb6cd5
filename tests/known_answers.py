"""Known answers: checksums of the fixture files by name, and of rectangles by bounds. Fixed values."""

FILES = {
    "pt0_v0.las": 11028328746053052755,
    "pt0_v1_pointwise.laz": 11028328746053052755,
    "pt0_v1.laz": 11028328746053052755,
    "pt0_v2.laz": 11028328746053052755,
    "pt1_v0.las": 6968680754700392151,
    "pt1_v1_pointwise.laz": 6968680754700392151,
    "pt1_v1.laz": 6968680754700392151,
    "pt1_v2_appended.laz": 6968680754700392151,
    "pt1_v2.laz": 6968680754700392151,
    "pt10_compat_v0.las": 11161703441503439096,
    "pt10_compat_v2.laz": 11161703441503439096,
    "pt10_v0.las": 5393856970312677231,
    "pt10_v3.laz": 11876196347234314189,
    "pt10_v4.laz": 11876196347234314189,
    "pt2_v0.las": 1424852124582068381,
    "pt2_v1_pointwise.laz": 1424852124582068381,
    "pt2_v1.laz": 1424852124582068381,
    "pt2_v2.laz": 1424852124582068381,
    "pt3_v0.las": 7723230971793920249,
    "pt3_v1_pointwise.laz": 7723230971793920249,
    "pt3_v1.laz": 7723230971793920249,
    "pt3_v2.laz": 7723230971793920249,
    "pt4_v0.las": 5283740014088240548,
    "pt4_v1_pointwise.laz": 5283740014088240548,
    "pt4_v1.laz": 5283740014088240548,
    "pt4_v2.laz": 5283740014088240548,
    "pt5_v0.las": 11392323350068748350,
    "pt5_v1_pointwise.laz": 11392323350068748350,
    "pt5_v1.laz": 11392323350068748350,
    "pt5_v2.laz": 11392323350068748350,
    "pt6_compat_v0.las": 6224352997680965369,
    "pt6_compat_v2.laz": 6224352997680965369,
    "pt6_v0.las": 646941970456200506,
    "pt6_v3.laz": 4897066137299017740,
    "pt6_v4.laz": 4897066137299017740,
    "pt7_compat_v0.las": 1589302098294028459,
    "pt7_compat_v2.laz": 1589302098294028459,
    "pt7_v0.las": 14386283179178824536,
    "pt7_v3.laz": 6500292274615412042,
    "pt7_v4.laz": 6500292274615412042,
    "pt8_compat_noextra_v0.las": 13753680780757782967,
    "pt8_compat_noextra_v2.laz": 13753680780757782967,
    "pt8_compat_v0.las": 7118112797396462679,
    "pt8_compat_v2.laz": 7118112797396462679,
    "pt8_v0.las": 4461920437272219272,
    "pt8_v3.laz": 571717328702288614,
    "pt8_v4.laz": 571717328702288614,
    "pt9_compat_v0.las": 3233255865305260334,
    "pt9_compat_v2.laz": 3233255865305260334,
    "pt9_v0.las": 9581944068831893933,
    "pt9_v3.laz": 6537355636582471359,
    "pt9_v4.laz": 6537355636582471359,
}

#: (min_x, min_y, max_x, max_y) -> (points, checksum of their ordinals)
RECTANGLES = {
    (1498.0, 1699.0, 1500.0, 1701.0): (47, 17365290153457815621),
    (1490.0, 1690.0, 1510.0, 1710.0): (500, 13582017138424482681),
    (1600.0, 1800.0, 1601.0, 1801.0): (0, 14695981039346656037),
    (1499.5, 1700.25, 1499.75, 1700.5): (0, 14695981039346656037),
    (1499.0, 1700.0, 1501.0, 1702.0): (76, 8751528821683858857),
    (1496.62, 1697.5, 1498.0, 1699.0): (23, 2292446750038796246),
    (1500.0, 1698.0, 1501.0, 1699.0): (27, 16744392822611109553),
    (1500.5, 1700.5, 1501.5, 1701.5): (2, 7591455579502869572),
}
