import sys

from voxmill.cli import main

sys.exit(main())
